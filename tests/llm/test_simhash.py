import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import components, simhash
from tests.llm.conftest import ODD


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, links):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def close(prints, radius=4):
    items = list(prints)
    values = np.array([prints[i] for i in items], np.uint64)
    return [(items[i], items[int(j)]) for i in range(len(items)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= radius) if i < j]


@pytest.mark.parametrize("text", [t or "" for _, t in ODD] + ["A B c d", "Ä B\u00a0C d e", "a b c d " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def family(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            y = x
            for _ in range(rng.randrange(7)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
            if rng.random() < 0.3:
                x = y  # chains
    return sorted(out)


@pytest.mark.parametrize("radius", range(5))
def test_bucket_links_connect_what_is_close(radius):
    rng = random.Random(radius)
    prints = family(rng, 300)
    run = sorted(rng.randrange(12) for _ in prints)
    rng.shuffle(prints)
    got = simhash.bucket_links(np.array(run), np.array(prints, np.uint64), radius)
    want = [(i, j) for i, j in close(dict(enumerate(prints)), radius) if run[i] == run[j]]
    assert set(got) <= set(want) and len(got) < len(prints) and roots(range(len(prints)), got) == roots(range(len(prints)), want)


@pytest.mark.parametrize("bucket", [8, 4096])
def test_links_lose_none_whatever_the_bucket(spark, bucket):
    prints = dict(enumerate(family(random.Random(3), 700)))
    df = spark.createDataFrame([(simhash._signed(v), k) for k, v in prints.items()], "fp long, rep long")
    got = [(r["a"], r["b"]) for r in simhash.near_duplicate_links(df, bucket=bucket).collect()]
    want = close(prints)
    assert {tuple(sorted(x)) for x in got} <= set(want) and roots(prints, got) == roots(prints, want)


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = simhash.block_masks(6, 2), random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, i) for i in range(5001, 5100)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {i: r for i, r in want.items() if i != r}


def test_near_duplicates(odd, none):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    prints = {d: plain_fingerprint(t or "") for d, t in ODD if d is not None}
    root = roots(prints, close(prints))
    assert {g for g in got if g[0] is not None} == {(d, f"{f:016x}", root[d]) for d, f in prints.items()}
    assert [g[2] for g in got if g[0] is None] == [None]
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).collect() == []


def test_a_doc_id_in_several_rows_joins_its_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four"), (2, "alpha beta gamma delta"), (3, "one two three four"), (4, "apart from all of them")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
