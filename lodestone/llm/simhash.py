"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within RADIUS differing bits agree on at least BLOCKS - RADIUS of BLOCKS blocks of bits, so each distinct
fingerprint is dealt to one bucket for every such choice of blocks: no link is lost. Inside a sorted partition all buckets
are compared at once: the fingerprints stand as 64 bit planes, a lag of d compares every row with the d-th row behind
it, differing bits are added in carry-save counters of one bit a pair, and words of pairs are abandoned as soon as all of them
exceed the radius. A bucket of more than BUCKET fingerprints is dealt again by blocks of its free bits (one of RADIUS + 1
must agree); as the fingerprints in it are distinct, that ends. Only links that join two parts of a bucket are emitted, so
a bucket of n rows gives fewer than n links.

Defined results: words are split at ASCII white space and A-Z lower-cased; null or blank text has fingerprint zero, and
such rows link like any others; texts of any length are hashed whole; rows that share a doc_id are one node; a null doc_id
gets the component of its fingerprint's other rows, else null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, slices, texts_of
from lodestone.llm.components import components

RADIUS = 4
SHINGLE = 4
#: More blocks make buckets smaller and deal each fingerprint oftener: 6 blocks for up to LOAD fingerprints a bucket value.
BLOCKS, LOAD = (6, 7, 8, 9), 64
#: A bucket of more fingerprints is dealt again by its free bits.
BUCKET = 4096
#: Rows of whole buckets that are compared together.
TOGETHER = 1 << 18
HASHES = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ends = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_digest
    n, counts = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, HASHES):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (as a signed long) of each row."""

    def run(batches):
        for batch in slices(batches):
            prints = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, equal: int, free: int = (1 << 64) - 1) -> list[int]:
    """Masks of each choice of equal of the blocks into which the bits of free are cut."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [sum(1 << b for b in bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(c) for c in combinations(cuts, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of bits, row j the bits j of all fingerprints, packed in words with a word of zeros behind."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    out = np.zeros((64, (-(-packed.shape[1] // 8) + 1) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def _within(planes: np.ndarray, lag: int, pairs: np.ndarray, radius: int) -> np.ndarray:
    """Of pairs (i stands for rows i and i + lag), those within the radius: bit-sliced, for radius 4 or less."""
    words, alive = np.unique(pairs >> 6, return_inverse=True)
    live = np.zeros(words.size, np.uint64)
    np.bitwise_or.at(live, alive, np.uint64(1) << (pairs & 63).astype(np.uint64))
    q, r = divmod(lag, 64)
    last = planes.shape[1] - 1
    low, high = np.minimum(words + q, last), np.minimum(words + q + 1, last)
    one, two, four, over = (np.zeros(words.size, np.uint64) for _ in range(4))
    for j in range(64):
        p = planes[j]
        other = p[low] >> np.uint64(r) if r else p[low]
        if r:
            other = other | (p[high] << np.uint64(64 - r))
        carry = p[words] ^ other
        one, carry = one ^ carry, one & carry
        two, carry = two ^ carry, two & carry
        four, carry = four ^ carry, four & carry
        over |= carry
        if j % 8 == 7:
            # the counters as a number, compared with the radius
            beyond = over.copy()
            if radius == 4:
                beyond |= four & (one | two)
            elif radius == 3:
                beyond |= four
            elif radius == 2:
                beyond |= four | (two & one)
            elif radius == 1:
                beyond |= four | two
            else:
                beyond |= four | two | one
            live &= ~beyond
            keep = live != 0
            if not keep.all():
                if not keep.any():
                    return pairs[:0]
                words, low, high, live, one, two, four, over = (x[keep] for x in (words, low, high, live, one, two, four, over))
    bits = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    return (words[:, None] * 64 + np.arange(64))[bits]


def bucket_links(run: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (row, row) that span each run's parts; rows of a run are neighbours and have distinct fingerprints."""
    _, first, size = np.unique(run, return_index=True, return_counts=True)
    long = np.repeat(size > 1, size)
    rows = np.flatnonzero(long)
    if not rows.size:
        return []
    starts = np.repeat(first, size)[rows]
    ends = np.repeat(first + size, size)[rows]
    planes, label, links = _planes(fp[rows]), rows.copy(), []
    place = np.searchsorted(rows, starts)  # where a row's run starts among rows
    longest = int(size.max())
    there = np.arange(rows.size)
    for lag in range(1, longest):
        there = there[rows[there] + lag < ends[there]]
        open_ = there[label[there] != label[there + lag]]
        if not open_.size:
            continue
        for i in _within(planes, lag, open_, radius).tolist():
            j = i + lag
            a, b = label[i], label[j]
            if a != b:
                links.append((int(rows[i]), int(rows[j])))
                part = label[place[i] : place[i] + (ends[i] - starts[i])]
                part[part == max(a, b)] = min(a, b)
    return links


def _compare(radius: int, bucket: int):
    """Sorted rows (mask, key, fp, rep) -> links (a, b), and rows of too large buckets dealt again by their free bits."""
    schema = pa.schema([("mask", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def again(mask: int, fp: np.ndarray, rep: np.ndarray):
        free = ~mask & ((1 << 64) - 1)
        for m in block_masks(radius + 1, 1, free):
            m = np.int64(_signed(m | (mask & ((1 << 64) - 1))))
            n = len(fp)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m)), pa.array(fp & m), pa.array(fp), pa.array(rep), pa.nulls(n, pa.int64())], schema=schema)

    def found(cols: list[np.ndarray]):
        mask, key, fp, rep = cols
        new = np.ones(len(fp), bool)
        new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
        run = np.cumsum(new)
        links = bucket_links(run, fp.view(np.uint64), radius)
        if links:
            i, j = np.array(links).T
            n = len(i)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 3 + [pa.array(rep[i]), pa.array(rep[j])], schema=schema)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        large = None  # (mask, key) of the bucket that is dealt again just now
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            held = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            while len(held[0]):
                mask, key = held[0], held[1]
                new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
                edges = np.concatenate([[0], new, [len(mask)]])
                sizes = np.diff(edges)
                # the last bucket may go on in the next batch
                if large == (mask[0], key[0]):
                    yield from again(int(mask[0]), held[2][: edges[1]], held[3][: edges[1]])
                    held = [h[edges[1] :] for h in held]
                    continue
                hot = np.flatnonzero(sizes > bucket)
                if hot.size and hot[0] == 0:
                    large = (mask[0], key[0])
                    continue
                end = edges[hot[0]] if hot.size else edges[-2]
                if end == 0 or (not hot.size and len(mask) < TOGETHER):
                    break
                yield from found([h[:end] for h in held])
                held = [h[end:] for h in held]
        if len(held[0]):
            yield from found(held)

    return run


def near_duplicate_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """prints(fp, rep), fp distinct -> links (a, b) of reps, enough to connect all that lie within the radius, step by step."""
    n = prints.count()
    blocks = next((b for b in BLOCKS if n <= LOAD * 2 ** (64 * (b - radius) // b)), BLOCKS[-1])
    masks = [F.lit(_signed(m)) for m in block_masks(blocks, blocks - radius)]
    rows = prints.select(F.explode(F.array(*masks)).alias("mask"), "fp", "rep").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp", "rep")
    links = None
    while True:
        dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        level = materialise(dealt.mapInArrow(_compare(radius, bucket), "mask long, key long, fp long, a long, b long"), "links")
        found = level.filter("b is not null").select("a", "b")
        links = found if links is None else links.union(found)
        # several ways lead to one choice of bits: once more distinct, a bucket shrinks with its free bits
        rows = level.filter("b is null").select("mask", "key", "fp", F.col("a").alias("rep")).distinct()
        if rows.isEmpty():
            return links


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that it reaches)."""
    prints = materialise(fingerprints(docs), "fingerprints")
    reps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    roots = components(near_duplicate_links(reps.filter("rep is not null"), radius))
    # a doc_id that stands in several rows joins their fingerprints
    shared = prints.join(reps, "fp").filter("doc_id > rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = prints.filter("doc_id is not null").select("doc_id", "fp").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id")
    several = materialise(several, "several")
    if not several.isEmpty():
        own = shared.join(several, F.col("a") == F.col("doc_id"), "left_semi")
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(own))
    classes = reps.join(roots, reps["rep"] == roots["id"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
