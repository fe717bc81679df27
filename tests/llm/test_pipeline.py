"""The pipeline's stages on a small planted corpus, and the registered queries on the smallest tables."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm import queries as llm_queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng, path = random.Random(1), tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice("the of and to that is with for".split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            words[10] = words[30] = "vilething"
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "s", 1) for i in range(1, 5)]  # copies
    docs += [(2000, "12 34 !!", "en", "s", 1), (2001, None, None, None, None), (3, docs[3][1], "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, planted):
    sf, docs = planted
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "simhash", "packing"] and corpus_pipeline.ORACLE_SQL is None
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r["doc_id"] for r in now.collect()))
    clean = [d for d, t, *_ in docs if not (t and "vilething" in t)]
    assert kept[0] == sorted(clean)
    assert kept[1] == sorted(d for d in clean if d < 2000)
    assert kept[2] == sorted({d for d in clean if d < 1000})
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(kept[2])
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_on_odd_rows(spark, planted, odd, none):
    """Nulls, empty and very long texts, repeated rows, no rows, columns of clashing names."""
    sf, _ = planted
    extra = odd.selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars", "'x' as _rejected", "1 as node")
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, sf)
        assert got.columns == extra.columns and set(ids(got)) <= set(ids(extra))
        empty = none.selectExpr("doc_id", "text", "lang", "'s' as source", "1L as n_chars")
        assert stage(spark, empty, sf).collect() == []
        if name == "simhash":
            assert ids(got) == sorted([1, 4, 5, 7, 8, 9, None, 10], key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, sf)
    assert set(ids(packed)) == set(ids(extra)) and corpus_pipeline.STAGES[-1][1](spark, none, sf).collect() == []


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if n.startswith("op")])
def test_registered_queries_run(spark, name):
    if not SF.exists():
        pytest.skip("tables are not here")
    rows = __spark_entry__.queries()[name](spark, str(SF)).collect()
    table = "pages" if name.startswith("op10") else "conversations" if name.startswith("op3") else "embeddings" if name.startswith("op11") else "documents"
    if table == "documents":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    elif table == "embeddings":
        assert sorted(r["vec_id"] for r in rows) == sorted(r["vec_id"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect())
    elif table == "pages":
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    else:
        assert -7 in {r["conv_id"] for r in rows}


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLE))
def test_sql_twins(spark, name):
    if not SF.exists():
        pytest.skip("tables are not here")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = llm_queries.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    cur = con.execute(llm_queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
