"""Operator 13 against a plain search for repeated windows."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import substrings
from lodestone.llm.blocks import numbered


def plain(rows, window):
    cut = [[w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t, *_ in rows]
    seen = {}
    for d, words in enumerate(cut):
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), []).append((d, i))
    gone = [set() for _ in cut]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    out = []
    for (doc_id, *_), words, g in zip(rows, cut, gone):
        kept = " ".join(w for i, w in enumerate(words) if i not in g)
        out.append((doc_id, len(words), len(g), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, window, chars, schema="doc_id long, text string"):
    out = substrings.deduplicate(spark.createDataFrame(rows, schema).repartition(3), window, chars, texts=True)
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, alphabet, n=60):
    """Texts that share passages of all lengths about the window, with runs, periods and copies."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(alphabet)}"
    passages = [[word() for _ in range(r.choice([3, 7, 8, 9, 20, 34, 35, 36, 60]))] for _ in range(8)]
    passages += [["again"] * 50, ["a", "b"] * 30, ["same"] * 36 + ["x"]]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(6)):
            words += [word() for _ in range(r.randrange(25))] + r.choice(passages)
        rows.append((i, r.choice([" ", "\n", " \t ", "\x0b"]).join(words)))
    return rows + rows[:9] + [(90, None), (91, ""), (None, " \n "), (92, rows[3][1] + " " + rows[3][1])]


@pytest.mark.parametrize("window", [2, 8, 35])
def test_equals_plain_search(spark, window):
    for seed, alphabet in ((1, 2), (2, 9), (3, 5000)):
        rows = corpus(seed, alphabet)
        assert run(spark, rows, window, 1500) == plain(rows, window)


def test_odd_rows(spark, odd, none):
    rows = [tuple(r)[:2] for r in odd.collect()]
    got = sorted((tuple(r) for r in substrings.deduplicate(odd, 5, texts=True).collect()), key=str)
    assert got == plain(rows, 5)
    assert substrings.deduplicate(none).collect() == []


def test_unrepeated_symbols_rule_out_windows_of_other_text():
    """The context of a symbol decides it: equal windows hold equal symbols, and most other windows are ruled out early."""
    r = np.random.default_rng(7)
    names = r.integers(0, 1 << 63, 40_000).astype(np.uint64)
    passage = names[5000:5400]
    names = np.concatenate([names, passage, r.integers(0, 1 << 63, 5000).astype(np.uint64)])
    sizes = np.array([20_000, len(names) - 20_000])
    found, low, high = substrings.symbols(names, sizes, 35)
    distinct, twice = substrings.ordered(found[None])
    at = substrings.possible(found, low, high, distinct[0][twice], sizes, 35)
    truly = set(range(5000, 5400 - 34)) | set(range(40_000, 40_400 - 34))
    assert truly <= set(at.tolist()) and len(at) < 2 * len(truly)


def test_names_that_share_a_lane():
    known = np.array([[1, 1, 1, 5], [2, 3, 9, 4]], np.uint64)
    asked = np.array([[1, 1, 1, 5, 5, 7, 0], [2, 9, 8, 4, 5, 1, 0]], np.uint64)
    assert substrings.found(known, asked).tolist() == [True, True, False, True, False, False, False]


def test_blocks_are_cut_by_size():
    own, held = numbered(np.array([5, 5, 5, 50, 1, 1]), 0, 10)
    assert own.tolist() == [0, 0, 1, 2, 3, 3] and held == 2
