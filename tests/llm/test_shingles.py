"""The pipeline's near duplicates against brute force over sets of five-word shingles."""

import random

import pytest

import corpus_pipeline
from lodestone.llm import shingles, simhash
from tests.llm.conftest import ODD
from tests.llm.test_simhash import roots


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def corpus():
    rng, out = random.Random(4), []
    for family in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(len(words) // 20)):
                copy[rng.randrange(len(words))] = f"n{rng.randrange(5000)}"
            out.append(" ".join(copy))
    common = " ".join(f"c{i}" for i in range(60))
    out += [f"{common} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    return list(enumerate(out, 100))


def test_stage_drops_copies_that_fingerprints_miss(spark):
    rows = corpus()
    sets = {i: plain_set(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])]
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    assert sum((prints[a] ^ prints[b]).bit_count() > 4 for a, b in pairs) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = roots(sets, pairs)
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(want.values())


def test_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in shingles.near_duplicates(odd).collect()}
    assert {d for d, _ in got} == {d for d, _ in ODD}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (None, None)} <= got
    assert shingles.near_duplicates(none).collect() == []


def test_rows_that_share_a_doc_id_are_one_node(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v"), (4, "other words here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in shingles.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("stream,cell", [(10_000, 2_000_000), (2, 150)])
def test_chains_over_several_tasks_and_cells(spark, monkeypatch, stream, cell):
    """Texts that drift: the first of a bucket is too far from the last, which others connect."""
    monkeypatch.setattr(shingles, "STREAM", stream)
    monkeypatch.setattr(shingles, "CELL", cell)
    rng, texts = random.Random(9), []
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        drift = []
        for _ in range(14):
            drift.append(" ".join(words))
            at = rng.randrange(100)
            words[at : at + 9] = [f"n{rng.randrange(5000)}" for _ in range(9)]
        rng.shuffle(drift)
        texts += drift
    rows = list(enumerate(texts, 1))
    sets = {i: plain_set(t) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])])
    assert 6 <= len(set(want.values())) < 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_duplicates(docs).collect()} == want


def test_cells_link_across_roots_only():
    a, b, c = (shingles.shingles(" ".join(f"{p}{i}" for i in range(30))) for p in "xyz")
    assert shingles.cell_links([1, 2, 3], [1, 1, 3], [a, a, a]) == [(1, 3)] and shingles.cell_links([1, 2, 3], [1, 2, 3], [a, b, c]) == []
    empty = shingles.shingles("")
    assert shingles.cell_links([4, 5], [4, 5], [empty, empty]) == [(4, 5)] and shingles.alike(empty, empty) and not shingles.alike(empty, a)
