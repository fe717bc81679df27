"""Texts that differ only in Unicode form."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evidence

FORMS = ["ﬁnal Oﬀer", "été ÉTÉ", "Ａ１ ｂ m² Straße ẞ ς", "İstanbul   x", "5 ㎡ 3 ㎏ ⑩ ½", "plain  TEXT", None]


@pytest.mark.parametrize("text", FORMS)
def test_forms(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.normalise("t").alias("n"), T.tokens(F.col("t")).alias("k")).first()
    if text is None:
        assert got["n"] is None
        return
    assert got["n"] == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()
    folded = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    assert got["k"] == re.findall("[a-z0-9]+", folded)


def test_quotes_in_another_form_are_supported(spark):
    sources = spark.createDataFrame([("s", "The final o\ufb03ce measures 20 m\u00b2 at the cafe\u0301.", None, None)], "source_id string, text string, version string, page int")
    quotes = ["office measures", "20 m2", "CAFÉ", "tea"]
    citations = spark.createDataFrame([(i, "s", q, None, None) for i, q in enumerate(quotes)], "citation_id int, source_id string, quote string, version string, page int")
    assert [r["supported"] for r in evidence.citation_support(citations, sources).orderBy("citation_id").collect()] == [True, True, True, False]
