import random

import pyarrow as pa
import pytest

from lodestone.operators import impact
from lodestone.plans import catalogue

ITEM = "item_id int, name string, keywords array<string>, has_source boolean"


def made(rng):
    word = lambda: f"word{min(rng.randrange(40), rng.randrange(40))}"
    changes = [(f"c{i}", [word() for _ in range(rng.randrange(25))]) for i in range(80)]
    return changes, [(i, [word() for _ in range(rng.randint(1, 12))]) for i in range(50)]


def by_hand(changes, items, minimum):
    scores = ((c, i, sorted(set(w) & set(k)), round(len(set(w) & set(k)) / len(set(k)), 4)) for c, w in changes for i, k in items)
    return sorted((c, i, ", ".join(both), score) for c, i, both, score in scores if score >= minimum)


def frames(spark, changes, items):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in changes], "change_id string, text string").repartition(3), spark.createDataFrame([(i, f"Item {i}", w, False) for i, w in items], ITEM)


def rows(df):
    return sorted((r["change_id"], r["item_id"], r["rationale"].split(": ", 1)[1].split(". Human")[0], r["relevance_score"]) for r in df.collect())


def test_neither_texts_nor_pairs_are_shuffled(spark):
    df = impact.impacts(*frames(spark, *made(random.Random(1))))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(change_id" not in plan and "hashpartitioning(concept" not in plan


@pytest.mark.parametrize("sent", [0, 1 << 20])
@pytest.mark.parametrize("minimum", [0, 0.25])
def test_many_blocks_of_candidates(spark, monkeypatch, sent, minimum):
    for name, n in (("CANDIDATES", 30), ("SENT", sent)):
        monkeypatch.setattr(impact, name, n)
    changes, items = made(random.Random(2))
    assert rows(impact.impacts(*frames(spark, changes, items), minimum)) == by_hand(changes, items, minimum)


@pytest.mark.parametrize("counted", [1, 100, 1 << 22])
def test_blocks_and_counts_of_any_size(monkeypatch, counted):
    for name, n in (("CHANGES", 60), ("COUNTED", counted)):
        monkeypatch.setattr(impact, name, n)
    changes, items = made(random.Random(3))
    own = pa.array([list(dict.fromkeys(w)) for _, w in changes], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in changes]), own], ["change_id", "own"])
    kind = pa.struct([("item_id", pa.int32()), ("name", pa.string()), ("has_source", pa.bool_()), ("_n", pa.int32()), ("_need", pa.int32()), ("_concepts", pa.list_(pa.string()))])
    of_items = pa.array([[(i, "", False, len(set(k)), 2, list(dict.fromkeys(k))) for i, k in items]], pa.list_(kind))
    blocks = list(impact._packed([batch.slice(0, 0), batch.slice(0, 33), batch.slice(33)]))
    assert len(blocks) > 10
    got = [r for b in blocks for out in impact._shared([pa.RecordBatch.from_arrays([*b.columns, of_items], ["change_id", "own", "items"])]) for r in out.to_pylist()]
    want = [(c, i, sorted(set(w) & set(k))) for c, w in changes for i, k in items if len(set(w) & set(k)) >= 2]
    assert sorted((r["change_id"], r["item_id"], r["overlap"]) for r in got) == sorted(want)


def test_odd_rows(spark):
    changed = spark.createDataFrame([("a", None), ("b", ""), ("c", "risk model"), ("c", "model"), ("d", "the of")], "change_id string, text string")
    items = spark.createDataFrame([(1, "Model", None, None), (2, None, [], True), (3, "Risk", ["risk", "appetite"], True), (None, "Model", None, True)], ITEM)
    got = sorted((r["change_id"], r["item_id"], r["relevance_score"], r["confidence_score"]) for r in impact.impacts(changed, items).collect())
    assert got == [("c", 1, 1.0, 0.9), ("c", 1, 1.0, 0.9), ("c", 3, 0.5, 0.78)]
    assert impact.impacts(changed, items.limit(0)).collect() == [] and impact.impacts(changed.limit(0), items).collect() == []


@pytest.mark.parametrize("name", ["impact_relevance", "impact_rationale"])
def test_a_query_reads_its_changes_once(spark, tmp_path, name):
    spark.createDataFrame([(i, "capital ratio of the bank\nliquidity ratio") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "capital ratio"), (2, "liquidity")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    assert len(df.collect()) == 20 * 3
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ReadSchema: struct<doc_id:") == 1 and "hashpartitioning(change_id" not in final
