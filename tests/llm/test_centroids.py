"""Operator 11 against a plain Lloyd iteration in exact integers."""

import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int"


def plain(rows, k, rounds, dim, scale=256.0):
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(scale * x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z", v) for i, v in kept)
    c = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, z)), n) for n, z in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            c[n] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, o in out if o == n) for n in range(len(c))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in out), key=str)


def run(spark, rows, k, rounds, dim):
    out = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k, rounds, dim)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 6))
    rows = [(i, [float(x) for x in centres[i % 9] + 0.2 * rng.normal(size=6)], "c", 1) for i in range(700)]
    rows += [(1000 + i, [0.25] * 6, "c", 1) for i in range(300)]  # a hot vector
    rows += [(2000 + i, [float(x) for x in rng.integers(-2, 3, 6) / 256], "c", 1) for i in range(300)]  # many ties
    for k, rounds in ((1, 2), (7, 3), (40, 5)):
        assert run(spark, rows, k, rounds, 6) == plain(rows, k, rounds, 6)


def test_whole_nodes_are_assigned_and_centroids_pruned():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(0, 50, (4000, 4)) + 1000 * g for g in range(4)])
    tree = centroids.Tree(centroids._tree_row(np.arange(len(points)), np.zeros(len(points), bool), points), 4)
    c = np.array([[25 + 1000 * g] * 4 for g in range(4)])
    by_node, by_leaf = [], []
    centroids.walk(tree, c, lambda node, a, b, z: by_node.append((b - a, z)), lambda rows, z, d: by_leaf.append(len(rows)))
    assert sum(n for n, _ in by_node) == 16_000 and not by_leaf and len(by_node) <= 8


@pytest.mark.parametrize("big", [1.0, 1e5, 1e300])
def test_odd_rows_and_large_components(spark, big):
    rows = [(1, None, "a", 1), (2, [], "a", 1), (3, [1.0, None], "a", 1), (4, [float("nan"), 1.0], "a", 1), (5, [float("inf"), 1.0], "a", 1), (6, [1.0, 2.0, 3.0], "a", 1)]
    good = [(7, [big, -big], "a", None), (7, [big, -big], "a", None), (8, [0.1, -0.1], None, 2), (None, [-big, 0.5], "a", 1), (9, [0.0, 0.0], "a", 1)]
    assert run(spark, rows + good, 3, 2, 2) == plain(good, 3, 2, 2)
    assert run(spark, rows, 3, 2, 2) == []
    assert run(spark, good[:1], 40, 5, 2) == plain(good[:1], 40, 5, 2)
