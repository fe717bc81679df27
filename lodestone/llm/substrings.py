"""Substring deduplication by recompression: words covered by a window of words that starts anywhere else go.

Rounds name runs of equal symbols, then pairs of a left and a right symbol; a symbol is left or right by a bit of its name, so
equal passages get equal symbols except near their ends. A name is a hash of what it stands for, so all tasks give the same
name without a join. Each symbol carries its context, the words that decide that it forms there. A window in which some
symbol with its context lies, and whose name occurs once in the corpus, cannot repeat; this rules out nearly all windows of
text that does not repeat. What is left is verified by names of 128 bits over whole windows.

Passes over the stored blocks: symbols of the last round, distinct in each block, are dealt by name, and names that occur
twice go back to their blocks; then the windows left, in the same way; then the words are removed. A symbol or window that
many texts share is one entry a block, so no task gathers its occurrences.

Defined results: a null, empty or blank text has no words and the digest of the empty text; texts shorter than a window keep
all words; equal rows, and rows that share a doc_id, are documents of their own, so both go where they are long enough; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import BLOCK_CHARS, blocks, parts_of
from lodestone.llm.common import materialise

WINDOW = 35

#: Odd multipliers of the names' mixing.
M1, M2, M3, RUN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Beyond every place: contexts that reach a document's edge.
FAR = np.int64(1 << 40)

NAMES = "bucket int, block long, names binary, twice binary"
FOUND = "block long, names binary"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a followed by b."""
    x = a * M1 + ((b << np.uint64(31)) | (b >> np.uint64(33))) * M2
    x ^= x >> np.uint64(29)
    x *= M3
    x ^= x >> np.uint64(32)
    return x


class Places(dict):
    """word -> its number, given when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of names, shape (2, words), of all texts' words (bytes.split() cuts at the same six characters), and each text's number of words."""
    places, numbers, sizes = Places(), [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().split() if text else []
        sizes[i] = len(words)
        numbers.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
    lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, places)), np.uint64).reshape(-1, 2).T
    return lanes[:, np.concatenate(numbers)] if numbers else np.zeros((2, 0), np.uint64), sizes


def parse(names: np.ndarray, head: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds: names, and where their contexts begin and end. head: which words begin a text."""
    low = np.arange(len(names), dtype=np.int64)
    high = low + 1

    def beside(low: np.ndarray, high: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the context becomes if the symbol before, or the one behind, decides."""
        before = np.where(head, -FAR, np.concatenate([[-FAR], low[:-1]]))
        behind = np.concatenate([np.where(head[1:], FAR, high[1:]), [FAR]])
        return np.minimum(low, before), np.maximum(high, behind)

    for k in range(rounds):
        if not len(names):
            break
        low, high = beside(low, high, head)
        same = np.concatenate([[False], (names[1:] == names[:-1]) & ~head[1:]])
        if same.any():
            at = np.flatnonzero(~same)
            length = np.diff(np.append(at, len(names))).astype(np.uint64)
            names = np.where(length > 1, mix(names[at], length * RUN), names[at])
            low, high, head = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), head[at]
        left = (names * RUN >> np.uint64(63 - k)) & np.uint64(1) == 1
        before, behind = beside(low, high, head)
        first = np.flatnonzero(left[:-1] & ~left[1:] & ~head[1:])
        wide = np.maximum(high[first], high[first + 1])
        low, high = np.where(left, low, before), np.where(left, behind, high)
        names = names.copy()
        names[first], high[first] = mix(names[first], names[first + 1]), wide
        stay = np.ones(len(names), bool)
        stay[first + 1] = False
        names, low, high, head = names[stay], low[stay], high[stay], head[stay]
    return names, low, high


def heads(sizes: np.ndarray) -> np.ndarray:
    """Which words begin a text."""
    out = np.zeros(int(sizes.sum()) + 1, bool)
    out[np.cumsum(sizes) - sizes] = True
    return out[:-1]


def symbols(names: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols whose contexts fit a window. Rounds: as many as leave a symbol of pairs alone inside a window."""
    names, low, high = parse(names, heads(sizes), max(0, window.bit_length() - 2))
    fit = high - low <= window
    return names[fit], low[fit], high[fit]


def starts(sizes: np.ndarray, window: int) -> np.ndarray:
    """Which words begin a window of their text."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    return np.arange(len(ends)) + window <= ends


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n places lie in some range from first to last, both included."""
    steps = np.bincount(np.maximum(first, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(last + 1, n), minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def possible(names: np.ndarray, low: np.ndarray, high: np.ndarray, repeated: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """The windows that hold no symbol, with its context, whose name is not among the repeated ones (sorted)."""
    once = ~found(repeated[None], names[None])
    ruled_out = covered(int(sizes.sum()), high[once] - window, low[once])
    return np.flatnonzero(starts(sizes, window) & ~ruled_out)


def windows(lanes: np.ndarray, window: int) -> np.ndarray:
    """Names, in both lanes, of the windows at all places (those that reach beyond the end are left out)."""
    n = lanes.shape[1]
    if n < window:
        return lanes[:, :0]
    size = 1
    while 2 * size <= window:
        lanes, size = mix(lanes[:, :-size], lanes[:, size:]), 2 * size
    return mix(lanes[:, : n - window + 1], lanes[:, window - size : n - size + 1])


def ordered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names (lanes by columns), sorted by their lanes, and which occur twice."""
    order = np.lexsort(names[::-1])
    names = names[:, order]
    new = np.concatenate([[True], (names[:, 1:] != names[:, :-1]).any(0)])[: names.shape[1]]
    at = np.flatnonzero(new)
    return names[:, at], np.diff(np.append(at, names.shape[1])) > 1


def found(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the asked names are among the known ones, which are sorted and distinct."""
    n = known.shape[1]
    out = np.zeros(asked.shape[1], bool)
    if not n:
        return out
    at = np.searchsorted(known[0], asked[0])
    left = np.flatnonzero((at < n) & (known[0][np.minimum(at, n - 1)] == asked[0]))
    while len(left):  # names that share the first lane follow each other
        out[left] = (known[:, at[left]] == asked[:, left]).all(0)
        left = left[~out[left]]
        at[left] += 1
        left = left[at[left] < n]
        left = left[known[0][at[left]] == asked[0][left]]
    return out


def dealt(names: np.ndarray, block: int, bits: int) -> pa.Table:
    """Rows of NAMES: a block's distinct names by their first bits."""
    names, twice = ordered(names)
    buckets = (names[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(names.shape[1], np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)] if len(buckets) else [0]
    rows = [(int(buckets[a]), block, np.ascontiguousarray(names[:, a:b].T).tobytes(), twice[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "names", "twice"])


def repeated(names: DataFrame, lanes: int) -> DataFrame:
    """NAMES rows -> (block, names): of each block's names those that occur twice anywhere. One bucket a task at a time."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("names").to_pylist()
        all_names = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, lanes).T
        sizes = np.array([len(p) // 8 // lanes for p in parts])
        order = np.lexsort(all_names[::-1])
        near = all_names[:, order]
        new = np.concatenate([[True], (near[:, 1:] != near[:, :-1]).any(0)])
        group = np.cumsum(new) - 1
        often = np.bincount(group, 1 + parts_of(table, "twice", bool)[order]) > 1
        keep = np.empty(len(order), bool)
        keep[order] = often[group]
        at, out = 0, []
        for block, size in zip(table.column("block").to_pylist(), sizes):
            own = all_names[:, at : at + size][:, keep[at : at + size]]
            at += size
            if own.shape[1]:
                out.append((block, np.ascontiguousarray(own.T).tobytes()))
        return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["block", "names"])

    return materialise(names.groupBy("bucket").applyInArrow(run, FOUND), "repeated")


def _texts(table: pa.Table) -> list[str | None]:
    return table.column("text").to_pylist()


def _known(table: pa.Table, lanes: int) -> np.ndarray:
    known = parts_of(table, "names", np.uint64).reshape(-1, lanes).T
    return known[:, np.lexsort(known[::-1])]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of a task by block; blocks follow each other in the stored files."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        own = np.asarray(batch.column("block"))
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                if held and held[0].column("block")[0].as_py() != int(own[a]):
                    yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("block")[0].as_py(), pa.Table.from_batches(held)


def deduplicate(docs: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, texts: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 of the words that stay, joined by spaces; texts: also those, as kept."""
    stored = blocks(docs, block_chars)
    # buckets of names as large as blocks' own names, about
    bits = max(3, stored.select("block").distinct().count().bit_length())

    def name_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _by_block(batches):
            lanes, sizes = words_of(_texts(table))
            yield from dealt(symbols(lanes[0], sizes, window)[0][None], block, bits).to_batches()

    shared = repeated(stored.mapInArrow(name_symbols, NAMES), 1)

    def name_windows(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return dealt(np.zeros((2, 0), np.uint64), 0, bits)
        lanes, sizes = words_of(_texts(table))
        at = possible(*symbols(lanes[0], sizes, window), _known(shared, 1)[0], sizes, window)
        return dealt(windows(lanes, window)[:, at] if len(at) else lanes[:, :0], table.column("block")[0].as_py(), bits)

    long = repeated(stored.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(name_windows, NAMES), 2)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts

    def remove(table: pa.Table, long: pa.Table) -> pa.Table:
        all_texts, known = _texts(table), _known(long, 2)
        lanes, sizes = words_of(all_texts)
        gone = np.zeros(lanes.shape[1], bool)
        if known.shape[1]:
            at = np.flatnonzero(starts(sizes, window))
            at = at[found(known, windows(lanes, window)[:, at])]
            gone = covered(len(gone), at, at + window - 1)
        ends, kept, removed = np.cumsum(sizes), [], np.zeros(len(sizes), np.int64)
        for i, text in enumerate(all_texts):
            own = gone[ends[i] - sizes[i] : ends[i]]
            words = text.encode().split() if text else []
            removed[i] = own.sum()
            kept.append(b" ".join(compress(words, (~own).tolist()) if removed[i] else words))
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        out = [table.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(digests, pa.string())]
        return pa.table(out + [pa.array([x.decode() for x in kept], pa.string())] * texts, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts)

    return stored.groupBy("block").cogroup(long.groupBy("block")).applyInArrow(remove, schema)
