"""Byte-level BPE by corpus-level merge replay.

All distinct pieces of a batch of texts form one small corpus. An inverted index leads from each adjacent pair that can
merge to the places where it stands; a heap hands out the lowest rank; applying it touches only the neighbours of the
merged places. Each piece sees its own merges in the same order as if it were encoded alone: lowest rank first, leftmost
first, and a merge that makes a pair of lower rank is interrupted for that pair.

Defined results: null text counts as empty; an empty text has no ids and decodes to no bytes; texts of any length are
encoded whole; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import held, slices, texts_of
from lodestone.llm.pieces import LeadEncoder, PieceCache

#: Token pairs whose merge a worker remembers, and pieces between spaces whose ids it keeps.
REMEMBERED, CHUNKS = 1_000_000, 800_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What two neighbouring tokens become: the rank of their joined bytes, or -1. Seen pairs are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.double = np.array(pairs, np.int64)
        self.seen: dict[int, int] = {}

    def rank(self, a: int, b: int) -> int:
        r = self.ranks.get(self.bytes[a] + self.bytes[b], -1)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[a << 32 | b] = r
        return r


def replay(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each piece. A piece that is a token by itself is that token."""
    ranks = merges.ranks
    out: list = [[ranks[p]] if p in ranks else [] for p in pieces]
    rest = [n for n, p in enumerate(pieces) if p and not out[n]]
    if not rest:
        return out
    lengths = np.array([len(pieces[n]) for n in rest])
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"".join([pieces[n] for n in rest]), np.uint8).astype(np.int64)
    place = np.arange(data.size) + np.repeat(np.arange(len(rest)), lengths)
    row = np.full(data.size + len(rest), -1, np.int64)  # all pieces in a row; a -1 ends each
    row[place] = merges.single[data]
    first = np.full(row.size, -1, np.int64)
    inner = np.flatnonzero(np.diff(place) == 1)
    first[place[inner]] = merges.double[data[inner] * 256 + data[inner + 1]]
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    heap, cuts = np.unique(first[at], return_index=True)
    index = dict(zip(heap.tolist(), map(np.ndarray.tolist, np.split(at, cuts[1:]))))  # rank -> places of the left half
    heap = heap.tolist()
    parts, rank_at = row.tolist(), first.tolist()
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    seen, find, push = merges.seen, merges.rank, heapq.heappush

    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        held = -1  # a piece whose remaining places of this rank wait for a lower rank ends here
        for i in places:
            if rank_at[i] != rank:
                continue  # a neighbour has changed since
            if i < held:
                index.setdefault(rank, []).append(i)
                continue
            j = after[i]
            k = after[j]
            parts[i], rank_at[j] = rank, -1
            after[i], before[k] = k, i
            lower = False
            c = parts[k]
            r = -1
            if c >= 0:
                r = seen.get(rank << 32 | c)
                if r is None:
                    r = find(rank, c)
                if r >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        push(heap, r)
                    lower = r < rank
            rank_at[i] = r
            h = before[i]
            c = parts[h]  # before the first piece stands the last -1
            if c >= 0:
                r = seen.get(c << 32 | rank)
                if r is None:
                    r = find(c, rank)
                rank_at[h] = r
                if r >= 0:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        push(heap, r)
                    lower = lower or r < rank
            if lower:
                held = k
                while parts[held] >= 0:
                    held = after[held]
        if rank in index:
            push(heap, rank)
    for n, i in zip(rest, starts.tolist()):
        ids = out[n]
        while parts[i] >= 0:
            ids.append(parts[i])
            i = after[i]
    return out


class ByteBpe:
    """Texts to little-endian unsigned 32-bit ids, and back."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(load_ranks(path))
        self.ranks, self.words = self.merges.ranks, self.merges.bytes
        self.split = regex.compile(pattern).findall
        self.encode = LeadEncoder(self._many, CHUNKS)
        self.pieces = PieceCache(lambda p: [array("I", x).tobytes() for x in replay([x.encode() for x in p], self.merges)])

    def _many(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        known = self.pieces.get(cut).__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, memoryview(ids).cast("I")))


def coder(path: str, pattern: str) -> ByteBpe:
    return held(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, full: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): the number of ids, the digest of the ids, and the digest of the decoded bytes.

    full adds the ids themselves (array<int>) and the decoded text. Narrow: one pass, no shuffle, bounded caches.
    """

    def run(batches):
        bpe = coder(path, pattern)
        for batch in slices(batches):
            encoded = bpe.encode(texts_of(batch))
            decoded = [bpe.decode(x) for x in encoded]
            cols = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array([array("I", x).tolist() for x in encoded], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if full else ""))
