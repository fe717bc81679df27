"""More underfull bins than one root takes."""

from collections import Counter

from lodestone.llm import packing
from tests.llm.test_tokens import BYTES


def test_no_task_takes_more_than_its_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE_ITEMS", 150)
    docs = spark.createDataFrame([(i, " a" * 1100) for i in range(600)], "doc_id long, text string")
    for parts in (1, 4):  # two never fit into one sequence
        rows = packing.pack(docs.repartition(parts), BYTES, 0).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(600)) and len({r["sequence_id"] for r in rows}) == 600
        tasks = Counter(r["sequence_id"] >> 32 for r in rows)
        assert len(tasks) == 4 and max(tasks.values()) <= 150


def test_several_levels_are_near_the_least_number_of_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "NODE_ITEMS", 40)
    monkeypatch.setattr(packing, "FAN", 2)
    docs = spark.createDataFrame([(i, " a" * (50 + 37 * i % 700)) for i in range(900)], "doc_id long, text string")
    rows = packing.pack(docs.repartition(16), BYTES, 0).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    tokens, sequences = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert len({r["sequence_id"] >> 56 for r in rows}) == 2 and sequences <= 1.03 * tokens / 2048 + 1
