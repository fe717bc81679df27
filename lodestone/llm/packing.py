"""Hierarchical residual packing of token sequences.

Each partition packs its pieces best-fit decreasing and closes bins that are nearly full; the others go up a tree as items
of the next best-fit round. A level has a FAN-th of the nodes of the one below, or as many as it takes that none gets over
NODE_ITEMS bins, to which open bins are dealt evenly by number; the last level, which closes all, is the one node at the top,
or the first level that could not have fewer nodes (a pool of that many items gains nothing from more). In the tree a bin is
its number and fill; what is in it joins its place at the end. Every level is a written table, so a lost executor costs one
level at most.

Defined results: null text counts as empty, an empty document is its end id alone; a document longer than the capacity is
cut from its end into full pieces, so only its first piece can be shorter; special strings in a text have the ids that the
library gives them; repeated rows are packed as often as they stand there; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import held, materialise, slices, texts_of
from lodestone.llm.pieces import LeadEncoder, byte_letters

FAN = 8
#: Bins that a task of the tree holds, at most.
NODE_ITEMS = 500_000
#: Items that a task of the first level holds before it packs them.
LOCAL_ITEMS = 400_000
#: Pieces that are encoded as one text.
JOINED = 2000
#: A bin with at most this share of its capacity free is closed before the last level.
SLACK = 1 / 256

MEMBERS = ("doc_id", "piece", "start", "length", "ids_crc32")
PLACES = "part long, nth long, done boolean, bin long, fill long, "
BINS = PLACES + ", ".join(f"{c} array<long>" for c in MEMBERS)
LINKS = PLACES + "child long, at long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteLevelIds:
    """Ids of a byte-level tokenizers file by tiktoken's encoder, some times faster; texts to 32-bit ids as bytes.

    The file must number its merges in their order, as rank files do; otherwise, and for pieces that cannot be told
    apart in a joined text, the tokenizers library encodes. The tests hold both to the same ids.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        special = self.tok.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in special):
            raise ValueError("special strings with white space cannot be cut at white space")
        self.special = re.compile("|".join(re.escape(t.content) for t in special) or r"(?!)")
        model = json.loads(self.tok.to_str())["model"]
        letters = byte_letters()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        made = set(merged)
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t in letters or t in made}
        numbers = [model["vocab"][m] for m in merged]
        self.fast = None
        if numbers == sorted(numbers) and len(ranks) == 256 + len(made):
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.leads = np.zeros(max(ranks.values()) + 1, bool)
            self.leads[[i for b, i in ranks.items() if b[:1] in (b" ", b"\n")]] = True

    def _slow(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._slow(texts)
        out: list = [None] * len(texts)
        marked = [i for i, t in enumerate(texts) if self.special.search(t)]
        for i, x in zip(marked, self._slow([texts[i] for i in marked])):
            out[i] = x
        joined = [i for i, t in enumerate(texts) if out[i] is None and t[:1] in (" ", "\n") and t.count(" ") + t.count("\n") == 1]
        for at in range(0, len(joined), JOINED):
            some = joined[at : at + JOINED]
            ids = np.array(self.fast.encode_ordinary("".join([texts[i] for i in some])), "<u4")
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) == len(some) and starts[0] == 0:
                raw, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(ids)]
                for i, s, e in zip(some, (starts * 4).tolist(), ends):
                    out[i] = raw[s:e]
        for i, x in enumerate(out):
            if x is None:
                out[i] = array("I", self.fast.encode_ordinary(texts[i])).tobytes()
        return out


def _encoder(path: str) -> LeadEncoder:
    return held(("packing", path), lambda: LeadEncoder(ByteLevelIds(path)))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at its end, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each bin. Of bins that fit equally well, the last opened."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f: a bin with f free
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if above := some >> size:
            free = size + (above & -above).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                some &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - size:
            by_free[left].append(b)
            some |= 1 << left
    return bins


def _numbered(level: int, bins: list[list[int]], sizes: list[int], capacity: int, counter: list[int], last: bool) -> tuple[list, ...]:
    """Columns part, nth, done, bin, fill of bins; counter holds the numbers of the next bin and of the next open one."""
    part = TaskContext.get().partitionId()
    fills = [sum(sizes[i] for i in own) for own in bins]
    done = [last or capacity - f <= capacity * SLACK for f in fills]
    nth, numbers = [], []
    for d in done:
        nth.append(counter[1])
        numbers.append(level << 56 | part << 32 | counter[0])
        counter[0] += 1
        counter[1] += not d
    return [part] * len(bins), nth, done, numbers, fills


def _merged(levels: list[DataFrame]) -> DataFrame | None:
    """(child, root, at): the sequence of each bin that the tree holds, and its place there; levels are those above the first."""
    above = None
    for level in reversed(levels):
        own = level.select("child", F.col("bin").alias("root"), "at", "done")
        if above is not None:
            up = above.select(F.col("child").alias("root"), F.col("root").alias("top"), F.col("at").alias("shift"))
            moved = own.filter(~F.col("done")).join(up, "root").select("child", F.col("top").alias("root"), (F.col("at") + F.col("shift")).alias("at"))
            own = own.filter("done").drop("done").union(moved)
        above = own.select("child", "root", "at")
    return above


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""

    def local(batches):
        encode, end = _encoder(path), array("I", [end_id]).tobytes()
        counter = [0, 0]
        doc_ids: list = []
        kept = [array("q") for _ in MEMBERS[1:]]  # a column each: no object an item

        def close():
            sizes = kept[2].tolist()
            bins = best_fit(sizes, capacity)
            lists = [[[c[i] for i in own] for own in bins] for c in (doc_ids, *kept)]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * len(MEMBERS)]
            cols = (*_numbered(0, bins, sizes, capacity, counter, False), *lists)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "nth", "done", "bin", "fill", *MEMBERS])

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts_of(batch))):
                ids = memoryview(ids + end)
                for k, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    doc_ids.append(doc_id)
                    for column, x in zip(kept, (k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]))):
                        column.append(x)
            if len(doc_ids) >= LOCAL_ITEMS:
                yield close()
                doc_ids.clear()
                kept = [array("q") for _ in kept]
        if doc_ids:
            yield close()

    first = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(local, BINS), "packed-0")
    levels: list[DataFrame] = []
    going = first.filter(~F.col("done")).select("part", "nth", "bin", "fill")
    while True:
        counts = going.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task of the level before
        before, rest = counts.agg(F.count("*"), F.sum("n")).first()
        if not rest:
            break
        nodes = max(-(-before // FAN), -(-rest // NODE_ITEMS))
        last = nodes == 1 or nodes >= before

        def merge(batches, level=len(levels) + 1, last=last):
            items = pa.Table.from_batches(batches, pa.schema([("node", pa.int32()), ("bin", pa.int64()), ("fill", pa.int64())])).sort_by([("fill", "descending"), ("bin", "ascending")])
            names, sizes = items["bin"].to_pylist(), items["fill"].to_pylist()
            bins = best_fit(sizes, capacity)
            out: list[list] = [[] for _ in range(7)]
            for *place, own in zip(*_numbered(level, bins, sizes, capacity, [0, 0], last), bins):
                at = 0
                for i in own:
                    for column, x in zip(out, (*place, names[i], at)):
                        column.append(x)
                    at += sizes[i]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["part", "nth", "done", "bin", "fill", "child", "at"])

        order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
        dealt = going.join(bases, "part").select(F.pmod(F.col("base") + F.col("nth"), F.lit(nodes)).cast("int").alias("node"), "bin", "fill")
        dealt = dealt.coalesce(1) if nodes == 1 else dealt.repartitionById(nodes, F.col("node"))
        levels.append(materialise(dealt.mapInArrow(merge, LINKS), f"packed-{len(levels) + 1}"))
        if last:
            break
        going = levels[-1].filter(~F.col("done") & (F.col("at") == 0)).select("part", "nth", "bin", "fill")

    def spread(batches):
        for batch in slices(batches, 4096):
            cols = batch.to_pydict()
            out: list[list] = [[] for _ in range(7)]
            for b, at, *members in zip(cols["bin"], cols["at"], *(cols[c] for c in MEMBERS)):
                for row in zip(*members):
                    for k, x in enumerate(row):
                        out[k].append(x)
                    out[5].append(b)
                    out[6].append(at)
                    at += row[3]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[*MEMBERS, "sequence_id", "offset"])

    placed = first.filter("done").select("bin", F.lit(0).cast("long").alias("at"), *MEMBERS)
    if levels:
        roots = _merged(levels)
        rest = first.filter(~F.col("done")).join(roots, F.col("bin") == F.col("child")).select(F.col("root").alias("bin"), "at", *MEMBERS)
        placed = placed.union(rest)
    return placed.mapInArrow(spread, PIECES + ", sequence_id long, offset long")
