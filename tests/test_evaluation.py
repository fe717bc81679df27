import pytest

from lodestone.operators import evaluation as E
from lodestone.sources import corpus


def metrics(spark, cases, k):
    ids = spark.createDataFrame([(str(i),) for i in range(len(cases))], "case_id string")
    wanted = spark.createDataFrame([(str(i), x) for i, (w, _) in enumerate(cases) for x in w], "case_id string, item string")
    ranked = spark.createDataFrame([(str(i), x, n + 1) for i, (_, r) in enumerate(cases) for n, x in enumerate(r)], "case_id string, item string, rank int")
    r = E.retrieval_summary(E.retrieval_cases(wanted, ranked, ids, k)).first()
    return r["recall_at_k"], r["mrr"]


def test_retrieval(spark):
    assert metrics(spark, [({"a"}, "xaz"), ({"b"}, "by"), ({"c"}, "xyc")], 2) == (0.6667, 0.6111)
    assert metrics(spark, [({"a", "b"}, ["a", "noise"])], 2)[0] == 0.5
    assert metrics(spark, [(set(), "ab")], 2) == (0, 0)


def test_classification(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "expected boolean, predicted boolean")
    r = E.classification(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    r = E.classification(df.limit(0)).first()
    assert (r["tp"], r["precision"], r["f1"]) == (0, 0, 0)


def test_intervals(spark):
    assert E.percentile([], 0.5) == 0 and E.percentile([1, 2, 3, 4], 0.5) == 2.5
    low, high = E.bootstrap([0, 1, 1], lambda v: sum(v) / len(v), samples=50, seed=7)
    assert (low, high) == E.bootstrap([0, 1, 1], lambda v: sum(v) / len(v), samples=50, seed=7) and 0 <= low <= high <= 1
    assert E.bootstrap([1], sum) is None
    for bad in ({"samples": 0}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            E.bootstrap([1, 2], sum, **bad)
    df = spark.createDataFrame([("g", i, float(i % 2)) for i in range(400)], "g string, k int, v double")
    r = E.poisson_bootstrap(df, "g", "k", "v").first()
    assert 0.4 < r["lower"] < 0.5 < r["upper"] < 0.6


def test_splits(spark):
    cases = spark.createDataFrame([("1", "test"), ("2", "train"), ("3", None)], "id string, split string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(E.select_split(cases, "all")) == ["1", "2", "3"] and ids(E.select_split(cases, "test")) == ["1", "3"] and ids(E.select_split(cases, "train")) == ["2"]
    assert ids(E.select_split(cases, "train", spark.createDataFrame([("3",)], "id string"))) == ["2", "3"]


def test_leaks(spark):
    items = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "family_id string, split string")
    assert [r["family_id"] for r in E.family_leaks(items).collect()] == ["f"]


def test_snapshots_and_counters(spark):
    files = spark.createDataFrame([("a", b"<!DOCTYPE html><p>"), ("b", b""), ("c", b"PK zip")], "path string, content binary")
    assert {r["path"]: r["rule"] for r in corpus.snapshot_violations(files).collect()} == {"a": None, "b": "empty", "c": "no_markup"}
    events = spark.createDataFrame([("GET", "/", 200, 0.004), ("GET", "/", 200, 3.0)], "method string, path string, status int, seconds double")
    h = {r["le"]: r["observations"] for r in corpus.latency_histogram(events).collect()}
    assert h["0.005"] == 1 and h["2.5"] == 1 and h["5.0"] == 2 and h["+Inf"] == 2


def test_json_and_repository(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{"dataset": "a",\n "version": "1"}')
    assert corpus.load_json(spark, str(p), ["dataset", "version"]).count() == 1
    with pytest.raises(ValueError):
        corpus.load_json(spark, str(p), ["retrieval"])
    corpus.write_documents(spark.createDataFrame([("1", "ext", "v1", "R")], "document_id string, external_id string, version string, regulator string"), str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    parts = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a"), ("2", 1, "z")], "document_id string, position int, content string")
    assert [r["content"] for r in corpus.look_up(docs, parts, "ext", "v1").collect()] == ["a", "b"]


@pytest.mark.parametrize(("buckets", "at_once"), [(E.BUCKETS, E.SORTED), (3, 2), (2, 1)])
def test_percentiles_by_selection(spark, buckets, at_once):
    """Against sorted values: ties, one value, huge and close values, groups of one, nulls."""
    import random

    rng = random.Random(3)
    groups = {"many": [rng.gauss(0, 9) for _ in range(300)], "ties": [float(rng.randrange(4)) for _ in range(200)], "one": [7.5], "two": [1.0, 2.0], "huge": [-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300], "same": [3.25] * 50, "close": [1.0 + k * 2.0**-52 for k in range(40)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None)]
    got = E.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.0, 0.025, 0.5, 0.975, 1.0], buckets, at_once).collect()
    assert {r["g"]: tuple(r)[1:] for r in got} == {g: tuple(E.percentile(vs, p) for p in (0.0, 0.025, 0.5, 0.975, 1.0)) for g, vs in groups.items()}
