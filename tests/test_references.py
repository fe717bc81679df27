"""Character references outside any short list."""

import html
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import structure
from tests.test_text_and_structure import one, parsed

REFERENCES = ["caf&eacute; &rsquo;x&#8217;", "&#xE9;t&#233; &euro;5 &amp;euro; &notit; &copy 2", "&#xD800; &#0; &bogus; &nbsp;end&emsp;", "plain"]


@pytest.mark.parametrize("raw", REFERENCES)
def test_all_references_are_decoded(spark, raw):
    once = lambda t: re.sub(r"[ \t\f\v]+", " ", html.unescape(t)).strip()
    assert [b["text"] for b in one(spark, structure.text_blocks(F.col("t")), t=raw)] == [once(raw)]
    page = f"<title>{raw}</title><h2>{raw}</h2><p>{raw}</p>"
    want = once(html.unescape(raw))
    assert one(spark, structure.html_title(F.col("t")), t=page) == want
    assert [b["text"] for b in one(spark, structure.html_blocks(F.col("t")), t=page)] == [want, want]
    assert [(r["text"], r["heading_path"]) for r in parsed(spark, page, html=True)] == [(want, [want])]
