"""Token-ID output: shards of ids compressed by a Re-Pair grammar, with random access.

A shard replaces frequent pairs of neighbouring symbols by nonterminals, round after round, each round on what the last
one left. It stores the rules, the length to which each nonterminal expands, the remaining symbols and, every BLOCK
symbols, how many ids stand before them; so a range of ids is decoded from the blocks that hold it.

Documents stand in ascending order of doc_id (rows that share one: by text; a null doc_id comes first); null text counts
as empty, an empty document is its end id alone; no document is split over shards, however long; special strings in a text
have the ids that the library gives them; an empty table gives no shards and no rows; other columns are ignored. Rows of one
doc_id, and those without one, stand in one task, as their order asks for.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import held, materialise, slices
from lodestone.llm.pieces import PieceCache, byte_letters

MAGIC = b"LRP2"
HEAD = struct.Struct("<4sIIIIQ")  # magic, vocabulary, rules, documents, symbols, ids
BLOCK = 1024
#: Ids that a shard gathers before it is closed.
SHARD_IDS = 1 << 19
#: A rule is stored in 8 bytes and saves 2 with each use: from 4 on it pays. Rounds go on until no pair occurs so often.
LEAST_COUNT = 4
#: A round replaces the pairs within this factor of its most frequent one.
SPREAD = 16
#: Hash buckets that tell which pairs may be frequent.
BUCKET_BITS = 18

SHARDS = "part long, base long, n_tokens long, n_docs long, payload binary"


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash bucket of each pair of symbols."""
    return ((a * np.uint32(2654435761) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _frequent(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs to replace in this round, places where one of them starts, which one): pairs as 64-bit keys."""
    bucket = _bucket(s[:-1], s[1:])
    places = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) >= LEAST_COUNT)[bucket])
    key = s[places].astype(np.uint64) << np.uint64(32) | s[places + 1]
    pairs, n = np.unique(key, return_counts=True)
    chosen = np.flatnonzero(n >= max(LEAST_COUNT, n.max(initial=0) // SPREAD))
    if not chosen.size:
        return pairs[:0], places[:0], places[:0]
    # of pairs that share a bucket the most frequent one; the others have their turn in later rounds
    pairs = pairs[chosen[np.argsort(n[chosen], kind="stable")]]
    table = np.full(1 << BUCKET_BITS, -1, np.int32)
    table[_bucket((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))] = np.arange(pairs.size)
    which = table[bucket[places]]
    hit = np.flatnonzero((which >= 0) & (pairs[which] == key))
    return pairs, places[hit], which[hit]


def compress(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules as pairs of symbols, remaining symbols); symbols from vocabulary on are nonterminals in order of rules."""
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = vocabulary
    while s.size > 1:
        pairs, places, which = _frequent(s)
        if not pairs.size:
            break
        # neighbouring places overlap: of each run take the first, third, ...
        first = np.ones(places.size, bool)
        first[1:] = np.diff(places) != 1
        run = np.maximum.accumulate(np.where(first, np.arange(places.size), 0))
        take = (np.arange(places.size) - run) % 2 == 0
        # half the places at least are taken, LEAST_COUNT / 2 a pair on average: some pair has two uses, so each round makes rules
        uses = np.bincount(which[take], minlength=pairs.size)
        take &= uses[which] >= 2
        number = np.cumsum(uses >= 2) - 1
        places = places[take]
        rules.append(pairs[uses >= 2])
        s[places] = (made + number[which[take]]).astype(np.uint32)
        made += rules[-1].size
        keep = np.ones(s.size, bool)
        keep[places + 1] = False
        s = s[keep]
    key = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32), s


def _bits(symbols: int) -> int:
    """Bits that so many symbols take, 16 at least."""
    return max(16, (symbols - 1).bit_length())


def _stored(x: np.ndarray, bits: int) -> bytes:
    """Low halves of 16 bits, then a plane of bits for each further one."""
    planes = [np.packbits((x >> np.uint32(k) & np.uint32(1)).astype(bool), bitorder="little") for k in range(16, bits)]
    return b"".join([x.astype("<u2").tobytes(), *(p.tobytes() for p in planes)])


class Stored:
    """A column of _stored symbols, read in ranges that start at a multiple of 8."""

    def __init__(self, take: Callable[[str, int], np.ndarray], n: int, bits: int):
        self.low, self.planes, self.size = take("<u2", n), [take("<u1", -(-n // 8)) for _ in range(16, bits)], n

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.size)
        out = self.low[a:b].astype(np.uint32)
        for k, plane in enumerate(self.planes, 16):
            out |= np.unpackbits(plane[a // 8 : -(-b // 8)], bitorder="little")[: b - a].astype(np.uint32) << np.uint32(k)
        return out


@lru_cache(maxsize=2)
def _terminals(vocabulary: int) -> tuple[bytes, ...]:
    return tuple(struct.pack("<I", i) for i in range(vocabulary))


class Shard:
    """A stored shard: whole decoding and random access."""

    def __init__(self, payload: bytes):
        magic, self.vocabulary, rules, docs, symbols, self.n = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(payload, kind, n, at)
            at += x.nbytes
            return x

        self.doc_ids, self.null, self.lengths = take("<i8", docs), take("<u1", docs), take("<u4", docs)
        bits = _bits(self.vocabulary + rules)
        self.rules, self.expands = Stored(take, 2 * rules, bits)[:].reshape(-1, 2), take("<u4", rules)
        self.blocks, self.symbols = take("<u8", -(-symbols // BLOCK)), Stored(take, symbols, bits)
        self._table: list[bytes] | None = None

    @staticmethod
    def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
        """ids of all documents in a row, end ids included; lengths says how many are each one's."""
        rules, symbols = compress(ids, vocabulary)
        size = [1] * vocabulary
        for a, b in rules.tolist():
            size.append(size[a] + size[b])
        expands, bits = np.array(size, np.uint32), _bits(len(size))
        before = np.concatenate([[0], np.cumsum(expands[symbols], dtype=np.uint64)])[:-1]
        return b"".join(
            [
                HEAD.pack(MAGIC, vocabulary, len(rules), len(doc_ids), len(symbols), len(ids)),
                np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                np.array([d is None for d in doc_ids], "<u1").tobytes(),
                np.array(lengths, "<u4").tobytes(),
                _stored(rules.reshape(-1), bits),
                expands[vocabulary:].astype("<u4").tobytes(),
                before[::BLOCK].astype("<u8").tobytes(),
                _stored(symbols, bits),
            ]
        )

    def _expand(self, symbols: np.ndarray) -> bytes:
        if self._table is None:
            self._table = list(_terminals(self.vocabulary))
            for a, b in self.rules.tolist():
                self._table.append(self._table[a] + self._table[b])
        return b"".join(map(self._table.__getitem__, symbols.tolist()))

    def read(self, start: int, end: int) -> bytes:
        """Ids start to end as little-endian unsigned 32-bit integers, from the blocks that hold them."""
        if end <= start:
            return b""
        first = int(np.searchsorted(self.blocks, start, "right")) - 1
        last = int(np.searchsorted(self.blocks, end, "left"))
        skip = int(self.blocks[first])
        return self._expand(self.symbols[first * BLOCK : last * BLOCK])[4 * (start - skip) : 4 * (end - skip)]

    def documents(self):
        """(doc_id, first id's place in the shard, ids) of each document."""
        ids = memoryview(self._expand(self.symbols[:]))
        at = 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.lengths.tolist()):
            yield None if null else doc_id, at, ids[4 * at : 4 * (at + n)]
            at += n


#: Marks that stand around words and are never joined with letters or digits into a token; in front of a letter, an apostrophe may be.
TAILS = string.punctuation
HEADS = TAILS.replace("'", "")
#: The end of a word, as a character that no word has.
END = "\0"
#: Characters that are encoded as one text.
JOINED = 1 << 16
#: Pieces that a worker keeps.
CACHED = 1_000_000
#: What is not a letter below U+0370 whose lower case is one letter.
BEYOND = re.compile("[^\0-\u012f\u0131-\u036f]")


class BlankTokenizer:
    """Ids of whole texts for tokenizers that drop white space and letter case, as 16-bit integers.

    A piece of letters below U+0370 (all in normal form), with marks around it, goes lower-cased to tiktoken's encoder, whose ranks
    are the file's own vocabulary with the end of a word as one more character; every other piece, special strings among
    them, goes through the library's tokenizer. The tests hold both to the same ids.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.vocabulary = self.tok.get_vocab_size()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        model = json.loads(self.tok.to_str())["model"]
        suffix, letters = model["end_of_word_suffix"], byte_letters()
        ranks = {}
        for token, i in model["vocab"].items():
            body = token.removesuffix(suffix)
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + END.encode() * (body != token)] = i
        merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        self.fast = None
        # rank files merge by the number of what is made: letters and ends of words first, then in order of merges
        if merged == sorted(set(merged)) and len(ranks) == 512 + len(merged) and all(ranks[bytes([b]) + END.encode()] < merged[0] for b in range(256)):
            self.fast = tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(max(ranks.values()) + 1, bool)
            self.ends[[i for b, i in ranks.items() if len(b) > 1 and b.endswith(END.encode())]] = True
        self.cache = PieceCache(self._many, CACHED)

    def _plain(self, pieces: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _source(self, piece: str) -> str | None:
        """The piece's words in lower case, each with its end; None if only the library can tell."""
        if piece.isalpha() and (piece.isascii() or not BEYOND.search(piece)):
            return piece.lower() + END
        body = piece.rstrip(TAILS)
        word = body.lstrip(HEADS)
        if word and not (word.isalpha() and (word.isascii() or not BEYOND.search(word))):
            return None
        out = word.lower() + END if word else ""
        if len(word) != len(body):
            out = body[: len(body) - len(word)] + END + out
        return out + piece[len(body) :] + END if len(body) != len(piece) else out

    def _many(self, pieces: list[str]) -> list[bytes]:
        if self.fast is None:
            return self._plain(pieces)
        sources = list(map(self._source, pieces))
        every = "\n".join(pieces)
        if any(x in every for x in self.special):
            sources = [None if any(x in p for x in self.special) else s for p, s in zip(pieces, sources)]
        out: list = [None] * len(pieces)
        own = [i for i, s in enumerate(sources) if s is not None]
        ids = [self.fast.encode_ordinary(part) for part in self._joined([sources[i] for i in own])]
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, sum(map(len, ids)))
        after = np.concatenate([[0], np.flatnonzero(self.ends[flat]) + 1])
        cuts = (2 * after[np.cumsum([0] + [sources[i].count(END) for i in own])]).tolist()
        raw = flat.tobytes()
        for i, a, b in zip(own, cuts, cuts[1:]):
            out[i] = raw[a:b]
        rest = [i for i, s in enumerate(sources) if s is None]
        for i, x in zip(rest, self._plain([pieces[i] for i in rest])):
            out[i] = x
        return out

    @staticmethod
    def _joined(sources: list[str]):
        held, size = [], 0
        for s in sources:
            held.append(s)
            size += len(s)
            if size >= JOINED:
                yield "".join(held)
                held, size = [], 0
        if held:
            yield "".join(held)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with the end id behind it; how many are each text's)."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        own = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.cache.find(own)
        known.append(struct.pack("<H", end))
        size = np.array(list(map(len, known)), np.int32) // 2
        start = np.cumsum(size, dtype=np.int32) - size
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        index = np.insert(pieces.indices.to_numpy(), ends, len(own))
        n = size[index]
        total = np.cumsum(n, dtype=np.int32)  # a batch of texts has fewer than 2**31 bytes
        places = np.repeat(start[index] - total + n, n)
        places += np.arange(places.size, dtype=np.int32)
        counts = np.diff(total[ends + np.arange(len(ends))], prepend=0)
        return np.frombuffer(b"".join(known), "<u2")[places], counts


def tokenizer(path: str) -> BlankTokenizer:
    return held(("tokens", path), lambda: BlankTokenizer(path))


def write_shards(docs: DataFrame, path: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Stored shards of docs(doc_id, text) in order of doc_id: part (rising with doc_id), base (ids of the part before the shard), payload."""

    def run(batches):
        tok = tokenizer(path)
        part, base = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        lengths: list[int] = []
        waiting: list[np.ndarray] = []
        size = 0

        def close():
            payload = Shard.build(doc_ids, lengths, np.concatenate(waiting), tok.vocabulary)
            row = {"part": [part], "base": [base], "n_tokens": [size], "n_docs": [len(doc_ids)], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("base", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())]))

        for batch in slices(batches):
            ids, counts = tok.encode(batch.column("text"), end_id)
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                doc_ids.append(doc_id)
                lengths.append(n)
                waiting.append(ids[at : at + n])
                at += n
                size += n
                if size >= shard_ids:
                    yield close()
                    base, size, doc_ids, lengths, waiting = base + size, 0, [], [], []
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(rows.mapInArrow(run, SHARDS), "token-shards", keep=True)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each partition of the writing stage
    bases, at = {}, 0
    for r in totals:
        bases[r["part"]] = at
        at += r["n"]

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            base = bases[row["part"]] + row["base"]
            found = [(d, base + at, len(x) // 4, zlib.crc32(x)) for d, at, x in Shard(row["payload"]).documents()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
