"""The twins of parsed texts decode character references by the queries' own rule."""

from html import unescape
from html.entities import html5

import duckdb
import pytest

from lodestone.plans import catalogue

PAGES = [
    "<title>One &amp two&amp</title><h1>One &amp two&amp</h1><p>a&ltb &amp;amp; &notit; &#150;&#xD800;&#11;</p>",
    "<title>x</title><p> &nbsp;one&nbsp;&nbsp;two&nbsp;</p><h2>&quot</h2><p>&quo &am &#; &zzz; &frac12x</p>",
]


@pytest.mark.parametrize("name", ["html_blocks", "html_title", "html_chunks", "ingest_chunks", "ingest_responses"])
def test_references_without_semicolons(spark, tmp_path, name):
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "R&ampD &lt;x&gt\n &copy 2 &amp;lt; ", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_every_name_and_number():
    con = duckdb.connect()
    texts = [f"&{n}" for n in html5] + [f"&{n}x" for n in html5] + [f"&#{n}" for n in [*range(300), *range(64970, 65010), 55296, 65535, 1114111, 1114112, 10**30]] + ["&", "&&#x", "&#x0041;b"]
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS x", [texts])
    for x, got in con.execute(f"SELECT x, {catalogue._sql_decoded('x')} FROM t").fetchall():
        assert got == unescape(x), x


NUMBER = "FR7630006000011234567890189"
TEXTS = [f"password={NUMBER} ción", f"ó{NUMBER} x", f"{NUMBER}ó", f"x {NUMBER}, {NUMBER} é.cd@x.com a@b.com.x@y.zz", "éa@b.com a@b.comé ñ-a.b@c-d.org_ _a@b.co Ⅷa@b.com"]


@pytest.mark.parametrize("name", ["sanitize_text", "sanitize_categories", "ingest_chunks"])
def test_word_edges_beyond_ascii(spark, tmp_path, name):
    spark.createDataFrame([(11 + 35 * i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"u{i}", f"<p>{t}</p>") for i, t in enumerate(TEXTS)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_capitals_of_a_sharp_s(spark, tmp_path):
    """In capitals a word of a sharp s and a letter has three letters, so it is a concept."""
    spark.createDataFrame([(3, "x ßö y\nßö Öß", "de", "s"), (4, "ßö", "de", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "ssö"), (2, "össß ssö")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES["impact_assessments"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got and got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE['impact_assessments']})").fetchall())
