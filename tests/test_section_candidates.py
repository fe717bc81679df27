"""Sections whose titles may match: small version pairs are shuffled once, whole ones of any size give the same pairs."""

import contextlib
import io
import random

import pytest

from lodestone.functions.similarity import ratio
from lodestone.operators import diff


def sections(spark, side, seed):
    r = random.Random(seed)
    rows = [(p, i, "".join(r.choices("abcde ", k=r.randint(0, 14))).strip(), "t") for p in (1, 2) for i in range(25)]
    return spark.createDataFrame(rows, f"pair_id long, {side}_idx long, title string, text string")


def test_small_version_pairs_are_not_exploded(spark):
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        diff._candidates(sections(spark, "old", 1), sections(spark, "new", 2), 0.485).explain()
    assert "Generate" not in plan.getvalue()


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_edges_by_either_way(spark, at_once, monkeypatch):
    monkeypatch.setattr(diff._candidates, "__defaults__", (at_once,))
    old, new = sections(spark, "old", 1), sections(spark, "new", 2)
    got = sorted(tuple(r) for r in diff._edges(old, new, 0.64).collect())
    want = []
    for a in old.collect():
        for b in new.collect():
            if a["pair_id"] == b["pair_id"] and a["title"] != b["title"]:
                score = round(0.7 * (ratio(a["title"], b["title"]) if a["title"] and b["title"] else 0.0) + 0.3, 4)
                if score >= 0.64:
                    want.append((a["pair_id"], a["old_idx"], b["new_idx"], score))
    assert got == sorted(want)
