"""Operators 2, 5 and 8 against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import byte_bpe, packing, pieces, token_store
from tests.llm.conftest import ODD

WORDS, BYTES, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


library = Tokenizer.from_file  # with its own settings: special strings in a text are special tokens
SPECIAL = ["<|endoftext|>", "a <|endoftext|>  b", "x<|endoftext|>y's\n<|endoftext|>\n", "(<|startoftext|>) <|ENDOFTEXT|>", " <|endoftext|> <|endoftext|>"]


def strange(n, seed=1):
    rng = random.Random(seed)
    return [t or "" for _, t in ODD] + SPECIAL + ["".join(rng.choice("abcTh e\n'1é.,!  \t的İß\u0301Σ|") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_word_tokenizer_is_the_library():
    tok, lib, texts = token_store.BlankTokenizer(WORDS), library(WORDS), strange(3000)
    assert tok.fast
    ids, counts = tok.encode(pa.array(texts), 2)
    for got, e in zip(np.split(ids, np.cumsum(counts)[:-1]), lib.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == [*e.ids, 2]


def test_byte_level_ids_are_the_library():
    enc, lib, texts = pieces.LeadEncoder(packing.ByteLevelIds(BYTES)), library(BYTES), strange(3000)
    for ids, e in zip(enc(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids


def test_small_caches_start_anew():
    texts = strange(300)
    small, large = (pieces.LeadEncoder(packing.ByteLevelIds(BYTES), n) for n in (50, 10**6))
    assert [small([t])[0] for t in texts] == large(texts)


def test_merge_replay_is_tiktoken():
    bpe, texts = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), strange(3000)
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for ids, text in zip(bpe.encode(texts), texts):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text) and bpe.decode(ids).decode() == text


@pytest.mark.parametrize("seed", range(20))
def test_merge_replay_with_ranks_out_of_order(seed):
    rng = random.Random(seed)
    made = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(25)}, key=lambda _: rng.random())
    ranks = {x.encode(): i for i, x in enumerate([*"abc", *made])}
    for b in range(256):
        ranks.setdefault(bytes([b]), 1000 + b)
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
    assert byte_bpe.replay([w.encode() for w in words], byte_bpe.Merges(ranks)) == [lib.encode_ordinary(w) for w in words]


def test_encode_decode(odd, none):
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    want = sorted(((d, len(i := lib.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ODD), key=str)
    assert sorted((tuple(r) for r in byte_bpe.encode_decode(odd, RANKS, public_tokenizers.PATTERN).collect()), key=str) == want
    assert byte_bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN, full=True).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 5000])
def test_shard_round_trip_and_random_access(n):
    rng = random.Random(n)
    phrase = [rng.randrange(49408) for _ in range(7)]
    docs = [np.array([2], "<u2").tobytes() if rng.random() < 0.1 else np.array([x for _ in range(rng.randrange(4)) for x in (phrase if rng.random() < 0.8 else [rng.randrange(49408)] * 9)] + [2], "<u2").tobytes() for _ in range(n)]
    shard = token_store.Shard(payload := token_store.Shard.build([i or None for i in range(n)], [len(d) // 2 for d in docs], np.frombuffer(b"".join(docs), "<u2"), 49408))
    assert [(d, bytes(x)) for d, _, x in shard.documents()] == [(i or None, np.frombuffer(d, "<u2").astype("<u4").tobytes()) for i, d in enumerate(docs)]
    every = b"".join(bytes(x) for _, _, x in shard.documents())
    for _ in range(50):
        a, b = sorted(rng.randrange(shard.n + 1) for _ in range(2))
        assert shard.read(a, b) == every[4 * a : 4 * b]
    if n == 5000:
        assert 2 * shard.symbols.size + shard.rules.nbytes < len(every) // 4 and len(shard.rules) > 5


def test_token_store(odd, none):
    lib = library(WORDS)
    got = token_store.read_documents(token_store.write_shards(odd, WORDS, 2, shard_ids=100)).orderBy("start").collect()
    want, at = [], 0
    for d, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_store.read_documents(token_store.write_shards(none, WORDS, 2)).collect() == []


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(60))]
        free: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [f for f in free if f >= s]
            if fits:
                free[free.index(min(fits))] -= s
            else:
                free.append(32 - s)
        bins = packing.best_fit(sizes, 32)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 32 for b in bins) and len(bins) == len(free)


@pytest.mark.parametrize("parts,items", [(1, 10**6), (11, 10**6), (11, 3)])
def test_pack(odd, none, parts, items, monkeypatch):
    monkeypatch.setattr(packing, "NODE_ITEMS", items)
    lib = library(BYTES)
    rows = packing.pack(odd.repartition(parts), BYTES, 0).collect()
    want = defaultdict(int)
    for d, t in ODD:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[tuple(r)[:5]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) + (1 if items > 3 else 4)
    assert packing.pack(none, BYTES, 0).collect() == []
