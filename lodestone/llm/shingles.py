"""Near duplicates by the Jaccard similarity of word shingles: candidates by SimHash and banded minima, then an exact check.

Two texts are linked if their sets of SHINGLE-word shingles have a Jaccard similarity of LEAST or more. Rows with equal sets
are one node. Candidates are pairs whose fingerprints operator 1's search links, and pairs that meet in a bucket: each set is
dealt to BANDS buckets by ROWS minima each, and a pair of similarity 0.8 meets in none with a chance of 8 in a million
(1 - 0.8 ** 7, to the power of 50), a more similar pair with less. So candidates only choose what is compared; they decide
nothing. Comparison has two steps, neither of which gathers a group:

1. Every member of a bucket is compared with the bucket's first member, unless both are one part already. Members stream past that first one, in several
   tasks if they are over STREAM; what agrees is connected. That settles groups of copies, of whatever size.
2. Buckets whose members are in several parts after that are cut into chunks of CELL shingles or less, and each pair of
   chunks is one cell, in which members of different parts are compared by counts over an inverted index.

Defined results: words are split at ASCII white space and A-Z lower-cased; a text of fewer words is one shingle; texts
without words are equal; texts of any length are compared whole; rows that share a doc_id are one; a null doc_id gets the
component of its set's other rows, else null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held, materialise, slices, texts_of
from lodestone.llm.components import components
from lodestone.llm.simhash import near_duplicate_links as simhash_links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 50, 7
#: Shingles whose minima are taken at a time.
TOGETHER = 512
#: Members of a bucket that one task compares with its first one.
STREAM = 10_000
#: Shingles of a chunk of a bucket (a longer text is a chunk by itself).
CELL = 2_000_000
#: Words whose hashes a worker keeps.
WORDS = 300_000

_rng = np.random.default_rng(20260915)
FLIPS = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
ODD = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
PLACES = _rng.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
MIXED = _rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = held("shingles", dict)
    if len(known) > WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for j in range(min(len(h), SHINGLE)):
        out += h[j : j + n] * PLACES[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A bucket of each band for a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, found.size, TOGETHER):
        low = np.minimum(low, ((found[at : at + TOGETHER] ^ FLIPS) * ODD).min(axis=1))
    mixed = ((low ^ (low >> np.uint64(31))).reshape(BANDS, ROWS) * MIXED).sum(axis=1, dtype=np.uint64)
    return mixed + np.arange(BANDS, dtype=np.uint64)


def majority(found: np.ndarray) -> int:
    """SimHash of a set of hashes: the bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, found.size, 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > found.size, bitorder="little").tobytes(), "little", signed=True)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest of the set, its size, its SimHash and its buckets, of each row."""

    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t) for t in texts_of(batch)]
            same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            keys = np.concatenate([band_keys(s) for s in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys))
            cols = [batch.column("doc_id"), batch.column("text"), same, pa.array([s.size for s in sets], pa.int64()), pa.array([majority(s) for s in sets], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "same", "size", "fp", "buckets"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, same binary, size long, fp long, buckets array<long>")


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sets (sorted hashes) are that similar; empty sets are alike."""
    if min(a.size, b.size) < least * max(a.size, b.size) - 1e-9:
        return False
    both = a.size + b.size - np.union1d(a, b).size
    return both >= least * (a.size + b.size - both) - 1e-9  # safe from rounding


def cell_links(nodes: list[int], roots: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Links of nodes, enough to connect all whose sets are that similar and whose roots differ, step by step."""
    size = np.array([s.size for s in sets])
    part, links = np.unique(roots, return_inverse=True)[1], []
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(len(sets)), size)[order]
    tokens = tokens[order]
    for i, s in enumerate(sets):
        if (part == part[0]).all():
            break
        first, end = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = end - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if s.size else np.zeros(0, np.int64)
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((both >= least * (size[i] + size - both) - 1e-9) & (part != part[i]))
        for p in np.unique(part[near]).tolist():
            links.append((nodes[i], nodes[int(near[part[near] == p][0])]))
            part[part == p] = part[i]
    return links


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _stream(batches):
    """Rows (b, first, node, text), in which a b's own text comes first -> links (a, b) of those that are alike."""
    key = own = None
    for batch in slices(batches):
        found = []
        for b, first, node, text in zip(*(batch.column(c).to_pylist() for c in ("b", "first", "node", "text"))):
            if first:
                if key != b:
                    key, own = b, shingles(text or "")
            elif alike(own, shingles(text or "")):
                found.append((node, b))
        yield _links(found)


def _cells(batches):
    """Rows (bucket, i, j, node, root, text), cell after cell -> links (a, b)."""
    key, nodes, roots, sets = None, [], [], []
    for batch in slices(batches):
        for bucket, i, j, node, root, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "root", "text"))):
            if key != (bucket, i, j):
                if len(nodes) > 1:
                    yield _links(cell_links(nodes, roots, sets))
                key, nodes, roots, sets = (bucket, i, j), [], [], []
            if not nodes or nodes[-1] != node:  # rows of one doc_id and one set
                nodes.append(node)
                roots.append(root)
                sets.append(shingles(text or ""))
    if len(nodes) > 1:
        yield _links(cell_links(nodes, roots, sets))


def candidates(nodes: DataFrame, dealt: DataFrame) -> DataFrame:
    """(a, b): nodes to compare, b the first of a bucket or what operator 1's search has linked."""
    least = dealt.groupBy("bucket").agg(F.min(F.struct("node", "size")).alias("least"), F.count("*").alias("n")).filter("n > 1").select("bucket", "least")
    sizes = F.least("size", "least.size") >= LEAST * F.greatest("size", "least.size") - 1e-9  # others cannot be alike
    stars = dealt.join(least.hint("merge"), "bucket").filter((F.col("node") > F.col("least.node")) & sizes).select(F.col("node").alias("a"), F.col("least.node").alias("b"))
    prints = materialise(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    equal = nodes.select("fp", "node").join(prints, "fp").filter("node > rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = simhash_links(prints).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return stars.union(equal).union(near).distinct()


def against_first(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose texts(node, text) are alike."""
    n = pairs.groupBy("b").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("parts"))
    many = n.filter("parts > 1")
    dealt = pairs.join(many, "b", "left").select("b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(False).alias("first"), F.col("a").alias("node"))
    firsts = n.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"), F.col("b").alias("node"))
    rows = dealt.union(firsts).join(texts.hint("merge"), "node").select("b", "part", "first", "node", "text")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.desc("first"), "node")
    return rows.select("b", "first", "node", "text").mapInArrow(_stream, "a long, b long")


def across(dealt: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links within buckets of dealt(bucket, node, size) whose members have several roots; None if there is no such bucket."""
    placed = dealt.join(roots.select(F.col("id").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "placed")
    mixed = placed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("size").alias("total"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")
    )
    # with two members, the first step has compared them; of buckets with the same members, one will do
    mixed = mixed.filter("n > 2 and low < high").groupBy("n", "members", "low", "high").agg(F.min("bucket").alias("bucket"), F.first("total").alias("total"))
    mixed = materialise(mixed.select("bucket", F.ceil((F.col("total") + 1) / CELL).cast("int").alias("chunks")), "mixed")
    if mixed.isEmpty():
        return None
    own = placed.join(mixed.hint("merge"), "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    own = own.select("bucket", "node", "root", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    own = own.select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "root")
    rows = own.join(texts.hint("merge"), "node").select("bucket", "i", "j", "node", "root", "text")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return materialise(rows.mapInArrow(_cells, "a long, b long"), "cell-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, component_id (smallest doc_id that it reaches)."""
    signed = materialise(signatures(docs), "signatures")
    named = signed.filter("doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("size", "fp", "buckets")]
    nodes = materialise(named.groupBy("same").agg(F.min("doc_id").alias("rep"), *firsts).withColumn("node", F.monotonically_increasing_id()), "nodes")
    dealt = nodes.select(F.explode("buckets").alias("bucket"), "node", "size")
    pairs = materialise(candidates(nodes, dealt), "candidates")
    met = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(nodes.select("node", "same", "rep"), "node")
    texts = named.select("same", F.col("doc_id").alias("rep"), "text").join(met.hint("merge"), ["same", "rep"]).select("node", "text")
    texts = materialise(texts, "texts")
    # each node with one candidate; then with its other ones that have not become one part with it
    one = pairs.groupBy("a").agg(F.min("b").alias("b"))
    found = components(materialise(against_first(one, texts), "links"))
    part = lambda c: found.select(F.col("id").alias(c), F.col("root").alias(f"part_{c}"))
    rest = pairs.join(one, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left")
    rest = materialise(rest.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b"), "rest")
    if not rest.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(against_first(rest, texts)))
    crowded = dealt.join(dealt.groupBy("bucket").count().filter("count > 2").select("bucket").hint("merge"), "bucket")
    more = [x for x in [across(crowded, found, texts)] if x is not None]
    # a doc_id that stands in several rows joins their sets
    sets = named.select("doc_id", "same").distinct()
    several = materialise(sets.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if not several.isEmpty():
        own = sets.join(several, "doc_id").join(nodes.select("same", "node"), "same").select("doc_id", "node")
        least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
        more.append(own.join(least, "doc_id").filter("node > b").select(F.col("node").alias("a"), "b"))
    if more:
        found = components(reduce(DataFrame.union, more, found.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    rooted = nodes.select("same", "rep", "node").join(found.withColumnRenamed("id", "node"), "node", "left")
    rooted = materialise(rooted.select("same", "rep", F.coalesce("root", "node").alias("root")), "rooted")
    named_by = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(named_by, "root").select("same", "component_id")
    return signed.select("doc_id", "same").join(classes, "same", "left").select("doc_id", "component_id")
