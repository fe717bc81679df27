"""The shard grammar goes on until no pair is frequent."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from lodestone.llm import token_store


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(5)
    one = rng.integers(0, 49_000, 700)
    copies = [x for _ in range(250) for x in (one, rng.integers(0, 49_000, 3))]
    ids = np.concatenate([*copies, rng.integers(0, 49_000, 350_000)]).astype(np.uint16)
    rules, left = token_store.compress(ids, 49_152)
    key = left[:-1].astype(np.uint32) << np.uint32(16) | left[1:]
    assert np.unique(key, return_counts=True)[1].max() < token_store.LEAST_COUNT == 4
    assert left.size < 250 * 5 + 350_000
    _same(ids)


def _same(ids):
    shard = token_store.Shard(token_store.Shard.build([1], [len(ids)], ids, 49_152))
    assert b"".join(bytes(x) for _, _, x in shard.documents()) == ids.astype("<u4").tobytes()
    return shard


def test_more_rules_than_16_bits_can_number():
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 49_000, (30_000, 2))
    ids = pairs[rng.permutation(np.repeat(np.arange(30_000), 6))].reshape(-1).astype(np.uint16)
    shard = _same(ids)
    assert len(shard.rules) > 16_384 and len(shard.symbols.planes) == 1
    assert shard.read(1001, 5003) == ids[1001:5003].astype("<u4").tobytes()


def test_texts_shrink_to_three_fifths():
    """Symbols and rules of one shard of the given documents, which are the same on every run."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id").column("text").combine_chunks()
    ids, _ = token_store.tokenizer(public_tokenizers.path("word_bpe_49k.json")).encode(texts, 2)
    ids = ids[: token_store.SHARD_IDS]
    rules, left = token_store.compress(ids, 49_408)
    assert len(rules) + left.size <= 0.6 * ids.size
