"""Cross-tokenizer alignment: byte offsets where tokens of two tokenizers both end cut them into groups; links join a group's tokens.

aligned() is the relational core, for any key: tokens by posexplode, ends by windowed cumulative lengths, cuts by an equi-join
on key and end, group numbers by a running count of cuts. Documents do not go through it token by token: texts are cut before
white space and before some marks, where both tokenizers always end a token, and each distinct part is aligned once. A
document's groups are those of its parts in order. Documents are kept in blocks as numbers of parts (see blocks); only parts
and counts are moved to them. Links of a group are taken between distinct ids, with how often each pair occurs.

Defined results: a text that is null or empty, or whose tokens' bytes in either tokenizer differ from a space and the text,
has no tokens: zeros and an empty digest; special strings are plain text; equal rows, and rows that share a doc_id, are
documents of their own, each counted; ties for an id's highest count are all best; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.blocks import bucketed, fresh
from lodestone.llm.common import discard, held, materialise, slices
from lodestone.llm.packing import ByteLevelIds
from lodestone.llm.pieces import byte_letters

#: Characters of a block of documents, about; (document, pair) entries that a task sorts at a time.
BLOCK_CHARS, ENTRIES = 14_000_000, 1_000_000
#: Letters and digits after which a mark may begin a part of its own, and such marks.
PLAIN, MARKS = "A-Za-z0-9À-ÖØ-öø-ɏ", "!#$%&*,.:;?|"

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
TOKENS = "id long, key long, key2 int, a array<int>, a_len array<int>, b array<int>, b_len array<int>"


# --- relational core


def ends(tokens: DataFrame, by: list[str], ids: str, lengths: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, end, ids, keep): each token with the offset where it ends."""
    rows = tokens.select(*by, *keep, F.posexplode(F.arrays_zip(ids, lengths)).alias("pos", "token"))
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, F.sum(f"token.{lengths}").over(before).alias("end"), F.col(f"token.{ids}").alias(ids), *keep)


@contextmanager
def partitioned_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Joins planned meanwhile use a partitioning by some of their keys as it is: here both sides lie by `by`, and so does what follows."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def aligned(tokens: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """tokens(by, a, a_len, b, b_len) -> (by, end, a, b, grp): a row for each offset where tokens end; a or b is null where only the other ends.

    keep: further columns of tokens, null where only b ends.
    """
    tokens = tokens.repartition(*by)
    both = ends(tokens, by, "a", "a_len", keep).join(ends(tokens, by, "b", "b_len"), [*by, "end"], "full")
    cut = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    before = Window.partitionBy(*by).orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("grp", cut.over(before))


# --- parts of texts


class Tokenizers:
    """Both tokenizers on parts of texts, with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevelIds(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.special, self.a.tok.encode_special_tokens = re.compile(r"(?!)"), True
        letters, vocabulary = byte_letters(), self.a.tok.get_vocab()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.b_bytes, inside = [], set()
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
            if not self.b.is_byte(i):
                inside.update(zip(piece, piece[1:]))
        if any(y == "▁" != x or "\n" in (x, y) for x, y in inside):
            raise ValueError("pieces that span words cannot be cut at white space")
        self.lengths = [np.zeros(max(known) + 1, np.int32) for known in (self.a_bytes, range(len(self.b_bytes)))]
        self.lengths[0][list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.lengths[1][:] = [len(x) for x in self.b_bytes]
        # a mark begins a part only if no piece holds it behind a plain letter
        plain = re.compile(f"[{PLAIN}]")
        marks = "".join(re.escape(m) for m in MARKS if not any(y == m and plain.match(x) for x, y in inside))
        self.pattern = rf"[ \n]?[^ \n{marks}]*[{PLAIN}](?=[{marks}])|[ \n]?[^ \n]+" if marks else r"[ \n]?[^ \n]+"
        self.parts = re.compile(self.pattern).findall

    def encode(self, parts: list[str]) -> tuple[list, list]:
        """Ids of each part as parts stand in a text: the second library's own leading space is the part's, or dropped."""
        a = [np.frombuffer(x, np.uint32) for x in self.a(parts)]
        # behind a line end, which is in no piece, nothing joins
        drop = [0 if p[0] == " " and len(p) > 1 else 1 if p[0] == "\n" else 2 for p in parts]
        asked = [(p[1:], p, "\n" + p)[d] for p, d in zip(parts, drop)]
        return a, [x[d:] for x, d in zip(self.b.encode(asked, num_threads=1), drop)]


_AWAY = re.compile(r"\s[ \n]|[ \n]\Z")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def parts_of_text(text: str, parts) -> list[str]:
    """A space and the text in parts that both tokenizers cut apart."""
    text = " " + text
    return _CUT.split(text) if _AWAY.search(text) else parts(text)


class Places(dict):
    """part -> its number, given when first asked for."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


CODED = "block long, doc_id long, ids binary, local int, part string"


def coded(docs: DataFrame, pattern: str, most: int = BLOCK_CHARS) -> DataFrame:
    """docs, cut by a pattern of parts, as a stored table of blocks: a row for each document with its parts' numbers, and a row for each part of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names, split = ["block", "doc_id", "ids", "local", "part"], re.compile(pattern).findall
        block, size, places = TaskContext.get().partitionId() << 32, 0, Places()

        def words() -> Iterator[pa.RecordBatch]:
            known = list(places)
            for at in range(0, len(known), 1 << 16):
                some = known[at : at + (1 << 16)]
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(some, pa.string())], names=names)

        for batch in slices(batches):
            owners, ids = [], []
            for text in batch.column("text").to_pylist():
                if size and size + len(text or "") > most:
                    yield from words()
                    block, size, places = block + 1, 0, Places()
                size += len(text or "")
                parts = parts_of_text(text, split) if text else []
                owners.append(block)
                ids.append(np.fromiter(map(places.__getitem__, parts), np.int32, len(parts)).tobytes())
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
        yield from words()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return bucketed(rows.mapInArrow(run, CODED), fresh("coded"))


def tokens_of(parts: DataFrame, load) -> DataFrame:
    """parts(key, key2, part) -> TOKENS, for parts whose tokens give the part's bytes; ids are numbers, shorter than keys."""

    def lists(values: list, lengths: np.ndarray) -> list:
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.concatenate([np.asarray(v, np.int32) for v in values]) if values else np.zeros(0, np.int32)
        at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return [pa.ListArray.from_arrays(at, pa.array(x)) for x in (flat, lengths[flat])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, number = load(), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 8192):
            parts = batch.column("part").to_pylist()
            a, b = both.encode(parts)
            good = [i for i, p in enumerate(parts) if (raw := p.encode()) == b"".join([both.a_bytes.get(t, b"") for t in a[i].tolist()]) and raw == b"".join([both.b_bytes[t] for t in b[i]])]
            keys = [batch.column(c).take(pa.array(good, pa.int64())) for c in ("key", "key2")]
            ids = pa.array(np.arange(number, number + len(good)))
            number += len(good)
            yield pa.RecordBatch.from_arrays([ids, *keys] + lists([a[i] for i in good], both.lengths[0]) + lists([b[i] for i in good], both.lengths[1]), names=["id", "key", "key2", "a", "a_len", "b", "b_len"])

    return materialise(parts.mapInArrow(run, TOKENS), "tokens", codec="zstd")


# --- what a part carries to its blocks


def packed(rows: DataFrame) -> DataFrame:
    """aligned() rows with keys -> (key, key2, code): for each id the width of its numbers, how many a and b, their ids, and a bit a token, set where a group's last a or b stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("packed", lambda: None)  # the worker's tokenizers are done with
        for batch in batches:
            lists = batch.column("r")
            sizes = np.asarray(lists.value_lengths(), np.int64)
            flat = lists.flatten()
            end, grp = (np.asarray(flat.field(c), np.int64) for c in ("end", "grp"))
            key = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((end, key))
            ids = [np.asarray(flat.field(c).fill_null(-1), np.int64)[order] for c in ("a", "b")]
            key, grp = key[order], grp[order]
            flat_ids, starts, bits = [], [], []
            for x in ids:
                here = x >= 0
                own, group = key[here], grp[here]
                last = np.concatenate([(own[1:] != own[:-1]) | (group[1:] != group[:-1]), [True]])[: len(own)]
                flat_ids.append(x[here])
                bits.append(last)
                starts.append(np.searchsorted(own, np.arange(len(sizes) + 1)))
            codes = []
            for (a, z), (b, y) in zip(*(zip(x[:-1].tolist(), x[1:].tolist()) for x in starts)):
                numbers = np.concatenate([[z - a, y - b], flat_ids[0][a:z], flat_ids[1][b:y]])
                kind = np.uint16 if numbers.max() < 1 << 16 else np.uint32
                codes.append(bytes([kind().itemsize]) + numbers.astype(kind).tobytes() + np.packbits(np.concatenate([bits[0][a:z], bits[1][b:y]])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("key2"), pa.array(codes, pa.binary())], names=["key", "key2", "code"])

    gathered = rows.groupBy("id").agg(F.max("key").alias("key"), F.max("key2").alias("key2"), F.collect_list(F.struct("end", "a", "b", "grp")).alias("r"))
    return materialise(gathered.select("key", "key2", "r").mapInArrow(run, "key long, key2 int, code binary"), "packed", codec="zstd")


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of consecutive runs: start, start + 1, ... for each."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Exact sums of consecutive runs."""
    total, ends_at = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(sizes)
    return total[ends_at] - total[ends_at - sizes]


class Parts:
    """The coded parts of a block as arrays; groups stand in the order of parts."""

    def __init__(self, local: np.ndarray, codes: list[bytes], n: int):
        """n: how many parts the block has; those without a code have no tokens."""
        data = np.frombuffer(b"".join(codes), np.uint8)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        at = np.cumsum(sizes) - sizes
        width = data[at].astype(np.int64) if len(at) else at
        at = at + 1

        def numbers(each: np.ndarray) -> np.ndarray:
            """So many numbers of each code, which is then read on behind them."""
            nonlocal at
            wide = np.repeat(width, each)
            place = np.repeat(at, each) + _runs(np.zeros(len(each), np.int64), each) * wide
            out = data[place].astype(np.int32)
            for k in range(1, 4):
                more = k < wide
                out[more] += data[place[more] + k].astype(np.int32) << (8 * k)
            at = at + each * width
            return out

        n_a, n_b = numbers(np.full(len(codes), 2)).reshape(-1, 2).T.astype(np.int64)
        self.a, self.b = numbers(n_a), numbers(n_b)
        ends = []
        for first, each in ((0 * n_a, n_a), (n_a, n_b)):
            bit = _runs(first, each)
            ends.append((data[np.repeat(at, each) + (bit >> 3)] >> (7 - (bit & 7))) & 1 == 1)
        self.good = np.zeros(n, bool)
        self.good[local] = True
        self.sizes = np.column_stack([np.diff(np.flatnonzero(x), prepend=-1) for x in ends])
        self.local, self.groups = local, np.bincount(np.repeat(np.arange(len(codes)), n_a)[ends[0]], minlength=len(codes))
        self.of_group = np.repeat(np.arange(len(local)), self.groups)
        links = _sums(self.sizes.prod(1), self.groups)
        self.numbers = np.zeros((n, 4), np.int64)
        self.numbers[local] = np.column_stack([n_a, n_b, self.groups, links])

    def pairs(self, some: int = 20_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Linked pairs of distinct ids by group, of so many coded parts at a time: the first part, how many pairs each has, a << 32 | b, how often each occurs."""
        ends = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (self.sizes[:, 0], self.sizes[:, 1], self.groups)]
        for at in range(0, len(self.groups), some):
            g, z = ends[2][at], ends[2][min(at + some, len(self.groups))]
            sides = []
            for side, ids in enumerate((self.a, self.b)):
                group = np.repeat(np.arange(z - g), self.sizes[g:z, side])
                known, often = np.unique(group << 32 | ids[ends[side][g] : ends[side][z]].astype(np.int64), return_counts=True)
                sides.append((known >> 32, known & 0xFFFFFFFF, often))
            (ga, a, ca), (gb, b, cb) = sides
            per = np.bincount(gb, minlength=z - g)
            other = _runs((np.cumsum(per) - per)[ga], per[ga])
            mine = np.repeat(np.arange(len(ga)), per[ga])
            n = np.bincount(self.of_group[g:z][ga[mine]] - at, minlength=min(some, len(self.groups) - at))
            yield at, n, a[mine] << 32 | b[other], ca[mine] * cb[other]

    def texts(self, some: int = 10_000) -> Iterator[str]:
        """Each coded part's groups, written out; numbers of so many parts at a time."""
        ends = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (self.sizes[:, 0], self.sizes[:, 1], self.groups)]
        for at in range(0, len(self.groups), some):
            first, last = ends[2][at], ends[2][min(at + some, len(self.groups))]
            a, b = (list(map(str, ids[e[first] : e[last]].tolist())) for ids, e in ((self.a, ends[0]), (self.b, ends[1])))
            groups, i, j = iter(self.sizes[first:last].tolist()), 0, 0
            for n in self.groups[at : at + some].tolist():
                made = []
                for _ in range(n):
                    x, y = next(groups)
                    made.append(",".join(a[i : i + x]) + "|" + ",".join(b[j : j + y]))
                    i, j = i + x, j + y
                yield ";".join(made)


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Part numbers of all documents, and each document's number of parts."""
    ids = table.column("ids")
    sizes = np.asarray(pc.binary_length(ids), np.int64) // 4
    return np.frombuffer(b"".join(ids.to_pylist()), np.int32), sizes


def _parts(table: pa.Table, ids: np.ndarray) -> Parts:
    local = np.asarray(table.column("local").combine_chunks(), np.int64)
    order = np.argsort(local)
    codes = table.column("code").to_pylist()
    return Parts(local[order], [codes[k] for k in order], int(ids.max()) + 1 if len(ids) else 0)


def _chunks(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose weights sum to about most."""
    reached, at = np.cumsum(weights), 0
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + most)))
        yield at, end
        at = end


def document_counts(parts: Parts, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's linked pairs and in how many of its documents each stands."""
    made = [(n, pair) for _, n, pair, _ in parts.pairs()] or [(np.zeros(0, np.int64),) * 2]
    known, number = np.unique(np.concatenate([pair for _, pair in made]), return_inverse=True)
    number = number.astype(np.int32)
    per = np.zeros(len(parts.good), np.int64)
    per[parts.local] = np.concatenate([n for n, _ in made])
    first, whole = np.cumsum(per) - per, _sums(~parts.good[ids], sizes) == 0
    del made
    counts, ends_at, n = np.zeros(len(known), np.int64), np.cumsum(sizes), max(1, len(parts.good))
    # whole documents, some ENTRIES of (document, pair) at a time
    for a, b in _chunks(_sums(per[ids], sizes) * whole, ENTRIES):
        doc = np.repeat(np.arange(b - a), np.where(whole[a:b], sizes[a:b], 0))
        own = ids[ends_at[a] - sizes[a] : ends_at[b - 1]][np.repeat(whole[a:b], sizes[a:b])]
        once = np.unique(doc * n + own)
        doc, part = once // n, once % n
        seen = np.unique(np.repeat(doc, per[part]) * len(known) + number[_runs(first[part], per[part])])
        counts += np.bincount(seen % len(known), minlength=len(known))
    return known[counts > 0], counts[counts > 0]


def _settled(df: DataFrame) -> DataFrame:
    """Lets Spark delete the shuffle files of finished steps before the next ones come."""
    for _ in range(2):  # what Python has let go reaches the JVM with a later call
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return df


def align(docs: DataFrame, a_path: str, b_path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) -> RESULT, under tokenizers file a (byte-level) and sentencepiece model b."""
    load = lambda: held(("alignment", a_path, b_path), lambda: Tokenizers(a_path, b_path))
    stored = coded(docs, Tokenizers(a_path, b_path).pattern, block_chars)
    texts = stored.filter("part is null").select("block", "doc_id", "ids")
    words = stored.filter("part is not null").select("block", "local", "part")
    # 96 bits of the part, by two hashes
    keys = [F.xxhash64("part").alias("key"), F.hash("part").alias("key2")]
    tokens = _settled(tokens_of(words.select("part").distinct().select(*keys, "part"), load))
    with partitioned_by_some_keys(docs.sparkSession):  # packed() plans and runs
        codes = packed(aligned(tokens, ["id"], ("key", "key2")))
    discard(tokens)
    codes = _settled(codes)
    nothing = lambda kind: F.lit(None).cast(kind)
    placed = words.select("block", "local", *keys).join(codes, ["key", "key2"])
    placed = placed.select("block", "local", "code", nothing("long").alias("pair"), nothing("long").alias("total"), nothing("boolean").alias("best"))
    n, table = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), fresh("placed")
    placed = _settled(bucketed(placed.repartition(n, "block"), table)).select("block", "local", "code")

    def count(docs: pa.Table, own: pa.Table) -> pa.Table:
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if docs.num_rows and own.num_rows:
            ids, sizes = _documents(docs)
            known, counts = document_counts(_parts(own, ids), ids, sizes)
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        return pa.table([pa.array(np.full(len(known), block)), pa.array(known), pa.array(counts)], names=["block", "pair", "n"])

    linked = texts.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(count, "block long, pair long, n long")
    linked = _settled(materialise(linked, "linked"))
    of_id = Window.partitionBy(F.shiftright("pair", 32))  # as many rows as b has ids, at most
    counts = linked.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("best", F.col("total") == F.max("total").over(of_id))
    known = linked.select("block", "pair").join(counts, "pair")
    # to the parts' table, so that each block finds its parts and counts where they lie
    more = known.select("block", nothing("int").alias("local"), nothing("binary").alias("code"), "pair", "total", "best")
    placed = _settled(bucketed(more.repartition(n, "block"), table, more=True))

    def result(docs: pa.Table, own: pa.Table) -> pa.Table:
        ids, sizes = _documents(docs)
        parts, asked = _parts(own.filter(own.column("code").is_valid()), ids), own.filter(own.column("pair").is_valid())
        pair, total, best = (np.asarray(asked.column(c).combine_chunks()) for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], best[order]
        scored = np.zeros((len(parts.good), 2), np.int64)
        for first, n, mine, often in parts.pairs() if len(pair) else ():
            # pairs of parts that only documents without tokens hold have no count
            at = np.minimum(np.searchsorted(pair, mine), len(pair) - 1)
            often = often * (pair[at] == mine)
            scored[parts.local[first : first + len(n)]] = np.column_stack([_sums(often * best[at], n), _sums(often * total[at], n)])
        whole = (_sums(~parts.good[ids], sizes) == 0) & (sizes > 0)
        numbers = np.concatenate([parts.numbers, scored], 1)
        columns = [np.where(whole, _sums(numbers[ids, c], sizes), 0) for c in range(6)]
        written = [""] * len(numbers)
        for k, text in zip(parts.local.tolist(), parts.texts()):
            written[k] = text
        del parts
        ends_at, digests = np.cumsum(sizes), []
        for i, size in enumerate(sizes.tolist()):
            own_ids = ids[ends_at[i] - size : ends_at[i]].tolist()
            digests.append(hashlib.sha256(";".join([written[k] for k in own_ids]).encode()).hexdigest() if whole[i] else "")
        return pa.table([docs.column("doc_id"), *map(pa.array, columns), pa.array(digests, pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return texts.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(result, RESULT)
