import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import search
from lodestone.streaming import index

CHUNKS = [("c1", "Le ratio minimal de fonds propres est de 8 pour cent."), ("c2", "Le ratio de liquidité doit être suivi au quotidien."), ("c3", "")]


def run(spark, query, **options):
    q = spark.createDataFrame([("q", query)], "query_id string, query string")
    return search.search(q, spark.createDataFrame(CHUNKS, "chunk_id string, text string"), **options).orderBy("rank").collect()


def test_gate_and_refusals(spark):
    found = run(spark, "ratio minimal de fonds propres", k=1)
    assert [r["chunk_id"] for r in found] == ["c1"] and found[0]["coverage"] == 1 and 0 < found[0]["score"] <= 1
    assert run(spark, "astronomie exoplanète télescope") == [] and run(spark, "the") == [] and run(spark, "what is the capital of Mongolia") == []
    assert run(spark, "ratio astronomy telescope") == []
    assert {round(r["coverage"], 4) for r in run(spark, "ratio astronomy telescope", coverage=0.0)} == {0.3333}
    assert [r["chunk_id"] for r in run(spark, "liquidite quotidien")] == ["c2"]


def test_bm25_by_hand(spark):
    rows = {r["chunk_id"]: r for r in run(spark, "ratio fonds fonds", coverage=0.0)}
    n, average, length = 3, (11 + 9 + 0) / 3, 11
    part = lambda df, tf, qtf: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average)) * qtf
    assert rows["c1"]["bm25"] == pytest.approx(part(2, 1, 1) + part(1, 1, 2))
    assert rows["c1"]["lexical"] == 1 and rows["c1"]["jaccard"] == pytest.approx(2 / 10)


def test_errors_and_status(spark):
    for bad in ({"k": 0}, {"coverage": 1.5}):
        with pytest.raises(ValueError):
            run(spark, "ratio", **bad)
    q = spark.createDataFrame([("a", "ratio fonds"), ("b", "the")], "query_id string, query string")
    s = search.status(q, search.search(q, spark.createDataFrame(CHUNKS, "chunk_id string, text string")))
    assert {r["query_id"]: r["status"] for r in s.collect()} == {"a": "evidence_found", "b": "insufficient_evidence"}


def test_order_of_input_does_not_matter(spark):
    q = spark.createDataFrame([("q", "ratio de fonds")], "query_id string, query string")
    a = search.search(q, spark.createDataFrame(CHUNKS, "chunk_id string, text string"), coverage=0.0)
    b = search.search(q, spark.createDataFrame(CHUNKS[::-1], "chunk_id string, text string").repartition(3), coverage=0.0)
    key = lambda df: [(r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]
    assert key(a) == key(b)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    assert [r["c"] for r in df.select(search.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1, 0, 0]
    with pytest.raises(Exception):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(search.cosine(F.col("a"), F.col("b"))).collect()


@pytest.mark.parametrize("seed", range(4))
def test_gated_search_is_the_full_search(spark, seed):
    """Also for queries that are mostly stop words, whose highest score belongs to a chunk that the gate does not pass."""
    import random

    rng = random.Random(seed)
    words = ["the", "of", "and", "to", "a", *(f"w{i}" for i in range(12))]
    chunks = [(i, " ".join(rng.choice(words[: rng.choice([5, 17])]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    queries = [(i, " ".join(["the"] * rng.randint(0, 6) + [rng.choice(words) for _ in range(rng.randint(1, 5))])) for i in range(25)] + [(99, "w0 the the the the the the the the of")]
    c, q = spark.createDataFrame(chunks, "chunk_id int, text string"), spark.createDataFrame(queries, "query_id int, query string")
    for coverage in (0.3, 1.0):
        want = search.scored(q, c).filter(F.col("coverage") >= coverage)
        rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["bm25"], 9), round(r["lexical"], 9), round(r["jaccard"], 9), round(r["coverage"], 9)) for r in df.collect())
        assert rows(search.gated(q, c, coverage)) == rows(want)


def test_index_maintenance(spark):
    df = lambda rows: spark.createDataFrame(rows, "document_id string, chunk_id string")
    first = df([("d1", "a"), ("d1", "b"), ("d2", "c")])
    two = index.upsert(first, df([("d1", "z")]))
    assert {(r[0], r[1]) for r in two.collect()} == {("d1", "z"), ("d2", "c")} and index.size(two).first()[0] == 2
    assert index.remove(two, df([("d2", "")])).count() == 1
    assert {r[0]: r[1] for r in index.removal_report(two, df([("d2", ""), ("d9", "")])).collect()} == {"d2": True, "d9": False}


def test_stream_keeps_the_last_write(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "index"
    schema = "document_id string, chunk_id string, seq long"
    spark.createDataFrame([("d1", "old", 1), ("d1", "new", 2), ("d2", "x", 1)], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    kept = "document_id string, chunk_id string"
    read = lambda: sorted(map(tuple, index.read_index(spark, str(target), spark.createDataFrame([], kept).schema).collect()))
    run = lambda: index.maintain(stream, str(target), str(tmp_path / "checkpoint"), parts=4).trigger(availableNow=True).start().awaitTermination(60)
    run()
    assert read() == [("d1", "new"), ("d2", "x")]
    spark.createDataFrame([("d2", "y", 3), ("d2", "z", 3), ("d3", "w", 1)], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert read() == [("d1", "new"), ("d2", "y"), ("d2", "z"), ("d3", "w")]


def test_statistics_are_kept_with_the_index(spark, tmp_path, monkeypatch):
    """After random upserts the kept statistics are those of the index, over a compaction too; superseded epochs are gone."""
    import random

    monkeypatch.setattr(index, "COMPACT", 3)
    rng = random.Random(2)
    kept = spark.createDataFrame([], "document_id string, chunk_id string, text string").schema
    source, target, stats = (str(tmp_path / x) for x in ("in", "index", "stats"))
    schema = "document_id string, chunk_id string, text string, seq long"
    stream = None
    for batch in range(5):
        rows = [(f"d{d}", f"d{d}-{batch}-{c}", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6))), batch) for d in rng.sample(range(6), 3) for c in range(rng.randint(1, 3))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = stream or spark.readStream.schema(schema).parquet(source)
        index.maintain(stream, target, str(tmp_path / "checkpoint"), 4, stats).trigger(availableNow=True).start().awaitTermination(120)
        now = index.read_index(spark, target, kept)
        want = index.folded(index.statistics(now))
        key = lambda df: sorted(map(str, df.select("term", "df", "chunks", "length").collect()))
        assert key(index.read_statistics(spark, stats)) == key(want)
    assert all(len(list(p.glob("epoch=*"))) <= 2 for p in (tmp_path / "index").glob("part=*"))


def test_micro_batches_read_touched_parts_only(spark, tmp_path):
    """The plan's partition filters name the parts, so no other folder is listed for reading."""
    rows = spark.createDataFrame([(f"d{i}", str(i)) for i in range(40)], "document_id string, chunk_id string")
    index.write_parts(rows, str(tmp_path), 1, 8)
    read = index.read_index(spark, str(tmp_path), rows.schema, parts=[3])
    plan = read._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("part" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    files = read.inputFiles()
    assert read.count() and files and all("part=3/" in f or "part=3%2F" in f for f in (f for f in files if "part=3" in f))


def test_tokens_of_every_code_point(spark):
    """Against the rule itself: case folded, decomposed, without combining marks, then letters a to z and digits."""
    import re
    import unicodedata

    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b" for c in codes[at : at + 64]) for at in range(0, len(codes), 64)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", tokens(F.col("text")).alias("t")).collect()
    for r in got:
        folded = "".join(x for x in unicodedata.normalize("NFKD", texts[r["i"]].casefold()) if not unicodedata.combining(x))
        assert r["t"] == re.findall("[a-z0-9]+", folded), r["i"]


def test_passages_are_found_by_their_words(spark):
    import random

    from lodestone.plans.workload import passages_in

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
    texts = [rng.choice(" \n").join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)]
    passages = [t[(at := rng.randrange(len(t))) : at + rng.randint(1, 30)] for t in texts if t] + ["", "zz"]
    p = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = sorted((i, j) for i, x in enumerate(passages) for j, t in enumerate(texts) if x in t)
    assert sorted(map(tuple, passages_in(p, d).collect())) == want
