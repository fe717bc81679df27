"""Centroid clustering: Lloyd rounds over integer vectors, filtered through kd-trees, exact in every step.

Each task builds kd-trees of at most TREE vectors and writes them to the shared folder, one row a tree: vectors in tree order,
and for every node its count, integer sums and box. A round walks the trees level by level with the centroids that are still
possible in each node; centroids that are strictly farther than another one from the whole box are pruned, a node with one
centroid left is assigned by its count and sums, and leaves are resolved exactly. Between rounds only counts and sums by
centroid move: they are added in each task, then by Spark; the driver holds k centroids.

Defined results: a vector that is null, of another length, or has a null or non-finite component is left out; components are
floor(scale * x), clamped to +-LIMIT so that every distance fits in a long (sums beyond it are clamped likewise); vectors at
the same distance from several centroids go to the smaller number; equal vectors and repeated ids are rows like any other; a
null vec_id stays and comes last in the choice of first centroids; with fewer vectors than k there are as many centroids as
vectors; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

#: Vectors of a tree at most, and of a leaf about.
TREE, LEAF = 16_384, 24
#: Integer components are at most so large; below EXACT all products are exact in doubles.
LIMIT, EXACT = 1 << 26, 1 << 20
MOST = (1 << 63) - 1

TREES = "n long, least long, ids binary, nulls binary, points binary, counts binary, sums binary, low binary, high binary"
PARTS = "cluster int, n decimal(38,0), squares decimal(38,0), sums array<decimal(38,0)>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles as integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)


def _depth(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and n."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of rows in which every node of the balanced tree is a range: medians along the widest side of the box."""
    order = np.arange(len(points))
    for level in range(_depth(len(points))):
        cuts, middles = _bounds(len(points), level), _bounds(len(points), level + 1)[1::2]
        for a, b, m in zip(cuts[:-1], cuts[1:], middles):
            own = order[a:b]
            some = points[own]
            side = int(np.argmax(some.max(0) - some.min(0)))
            order[a:b] = own[np.argpartition(some[:, side], m - a)]
    return order


def _tree_row(ids: np.ndarray, nulls: np.ndarray, points: np.ndarray) -> dict:
    order = tree_order(points)
    ids, nulls, points = ids[order], nulls[order], points[order]
    n, counts, sums, low, high = len(points), [], [], [], []
    for level in range(_depth(n) + 1):
        at = _bounds(n, level)
        counts.append(np.diff(at))
        sums.append(np.add.reduceat(points, at[:-1]))
        low.append(np.minimum.reduceat(points, at[:-1]))
        high.append(np.maximum.reduceat(points, at[:-1]))
    narrow = [x.astype(np.int32).tobytes() for x in (points, np.concatenate(low), np.concatenate(high))]
    return {"n": n, "least": int(np.abs(points).max()), "ids": ids.tobytes(), "nulls": nulls.tobytes(), "points": narrow[0], "counts": np.concatenate(counts).tobytes(), "sums": np.concatenate(sums).tobytes(), "low": narrow[1], "high": narrow[2]}


def _kept(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, and integer vectors of the rows that count."""
    lists, ids = batch.column("v"), batch.column("id")
    fit = np.flatnonzero(np.asarray(lists.value_lengths().fill_null(-1)) == dim)
    rows = lists.take(pa.array(fit))
    x = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(fit), dim)  # a null is not a number
    good = np.isfinite(x).all(1)
    ids = ids.take(pa.array(fit[good]))
    return np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null(), bool), whole(x[good], scale)


def build(vectors: DataFrame, dim: int, scale: float) -> DataFrame:
    """vectors(vec_id, embedding) as a table of kd-trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        schema = pa.schema([("n", pa.int64()), ("least", pa.int64()), *((c, pa.binary()) for c in ("ids", "nulls", "points", "counts", "sums", "low", "high"))])

        def trees(parts: list) -> Iterator[pa.RecordBatch]:
            whole_set = [np.concatenate(x) for x in zip(*parts)]
            for at in range(0, len(whole_set[0]), TREE):
                yield pa.RecordBatch.from_pylist([_tree_row(*(x[at : at + TREE] for x in whole_set))], schema)

        for batch in batches:
            held.append(_kept(batch, dim, scale))
            if sum(len(x[0]) for x in held) >= TREE:
                yield from trees(held)
                held = []
        if held:
            yield from trees(held)

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return materialise(rows.mapInArrow(run, TREES), "trees")


class Tree:
    """A row of the table of trees."""

    def __init__(self, row: dict, dim: int):
        self.n, self.least = row["n"], row["least"]
        shaped = lambda c, kind: np.frombuffer(row[c], kind).reshape(-1, dim)
        self.points, self.low, self.high = shaped("points", np.int32), shaped("low", np.int32), shaped("high", np.int32)
        self.sums, self.counts = shaped("sums", np.int64), np.frombuffer(row["counts"], np.int64)
        self.ids, self.nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)


def walk(tree: Tree, centroids: np.ndarray, node_is, leaf_is) -> None:
    """Assigns a tree. node_is(node number, first row, last row, centroid) for whole nodes; leaf_is(rows, centroids, distances) for the rest."""
    kind = np.float64 if max(tree.least, int(np.abs(centroids).max())) <= EXACT else np.int64
    c = centroids.astype(kind)
    cc = (c * c).sum(1)
    nodes, possible = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    depth = _depth(tree.n)
    for level in range(depth + 1):
        at, first = _bounds(tree.n, level), (1 << level) - 1
        low, high = tree.low[first + nodes].astype(kind), tree.high[first + nodes].astype(kind)
        twice_middle, width = low + high, high - low
        score = np.where(possible, (cc - twice_middle @ c.T), np.iinfo(np.int64).max if kind is np.int64 else np.inf)
        best = score.argmin(1)
        for z in np.unique(best):
            rows = np.flatnonzero(best == z)
            away = c - c[z]
            # the least of |x - c|^2 - |x - z|^2 over the box
            nearest = cc - cc[z] - twice_middle[rows] @ away.T - width[rows] @ np.abs(away).T
            possible[rows] &= nearest <= 0
        alone = possible.sum(1) == 1
        for k in np.flatnonzero(alone):
            node_is(first + nodes[k], at[nodes[k]], at[nodes[k] + 1], int(best[k]))
        nodes, possible = nodes[~alone], possible[~alone]
        if not len(nodes):
            return
        if level < depth:
            nodes, possible = (2 * nodes[:, None] + np.arange(2)).ravel(), possible.repeat(2, 0)
    sizes = at[nodes + 1] - at[nodes]
    rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in nodes])
    x = tree.points[rows].astype(kind)
    distances = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + cc
    distances[~possible.repeat(sizes, 0)] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
    own = distances.argmin(1)  # the first of several nearest ones
    leaf_is(rows, own, distances[np.arange(len(rows)), own].astype(np.int64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid: how many vectors are nearest to it, the sum of their squares, and their componentwise sums."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        counts, squares, sums = np.zeros(k, object), np.zeros(k, object), np.zeros((k, dim), object)
        for row in _rows(batches):
            tree = Tree(row, dim)
            n, added, own = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.empty(tree.n, np.int64)

            def node_is(node, a, b, z, tree=tree, n=n, added=added, own=own):
                n[z] += tree.counts[node]
                added[z] += tree.sums[node]
                own[a:b] = z

            def leaf_is(rows, z, _, tree=tree, n=n, added=added, own=own):
                n += np.bincount(z, minlength=k)
                np.add.at(added, z, tree.points[rows])
                own[rows] = z

            walk(tree, centroids, node_is, leaf_is)
            norms = (tree.points.astype(np.int64) ** 2).sum(1)
            for z in np.flatnonzero(n):
                squares[z] += sum(map(int, norms[own == z])) if tree.least > EXACT else int(norms[own == z].sum())
            counts += n
            sums += added
        exact = [(int(z), decimal.Decimal(int(counts[z])), decimal.Decimal(int(squares[z])), [decimal.Decimal(int(x)) for x in sums[z]]) for z in range(k) if counts[z]]
        wide = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in exact], pa.int32()), pa.array([x[1] for x in exact], wide), pa.array([x[2] for x in exact], wide), pa.array([x[3] for x in exact], pa.list_(wide))], names=["cluster", "n", "squares", "sums"])

    parts = trees.mapInArrow(run, PARTS)
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dim)))
    return {r["cluster"]: (int(r["n"]), int(r["squares"]), [int(r[f"s{d}"]) for d in range(dim)]) for r in added.collect()}  # k rows


def first_centroids(vectors: DataFrame, dim: int, scale: float, k: int, salt: str) -> np.ndarray:
    """The kept vectors with the smallest SHA-256 of salt:vec_id, in that order; a top-k, so no task sorts the table."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).filter((F.size(v) == dim) & ~bad)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    return whole(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim), scale)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2") -> DataFrame:
    """vectors(vec_id, embedding): each kept one with its cluster, its distance, and its cluster's and the whole inertia."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, dim, scale, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    trees = build(vectors, dim, scale)
    for _ in range(rounds):
        for z, (n, _, sums) in totals(trees, centroids).items():
            centroids[z] = [s // n for s in sums]
    inertia = dict.fromkeys(range(len(centroids)), 0)
    for z, (n, squares, sums) in totals(trees, centroids).items():
        c = list(map(int, centroids[z]))
        inertia[z] = squares - 2 * sum(a * b for a, b in zip(c, sums)) + n * sum(a * a for a in c)
    everything = min(MOST, sum(inertia.values()))
    own = np.array([min(MOST, inertia[z]) for z in range(len(centroids))], np.int64)
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            tree = Tree(row, dim)
            z, far = np.empty(tree.n, np.int32), np.empty(tree.n, np.int64)

            def node_is(_, a, b, c, tree=tree, z=z, far=far):
                z[a:b] = c
                far[a:b] = ((tree.points[a:b] - centroids[c]) ** 2).sum(1)

            def leaf_is(rows, c, distances, z=z, far=far):
                z[rows], far[rows] = c, distances

            walk(tree, centroids, node_is, leaf_is)
            ids = pa.array(tree.ids, mask=tree.nulls)
            yield pa.RecordBatch.from_arrays([ids, pa.array(z), pa.array(far), pa.array(own[z]), pa.array(np.full(tree.n, everything)), digests.take(pa.array(z))], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return trees.mapInArrow(run, RESULT)
