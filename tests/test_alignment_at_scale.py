"""Section alignment against taking scored pairs one by one; similarity against the standard library's."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity
from lodestone.operators import diff

SECTION = "pair_id string, idx long, section_id string, title string, text string"


def texts(r, n, alphabet):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("small", [0, 40, similarity.SMALL])
def test_ratio_equals_the_standard_one(monkeypatch, small):
    monkeypatch.setattr(similarity, "SMALL", small)
    r = random.Random(small)
    for _ in range(1500):
        alphabet = r.choice(["a", "ab", "abc", "the bank of  ", "é😀x\ud800"])
        a = texts(r, r.randrange(60), alphabet)
        b = texts(r, r.randrange(60), alphabet) if r.random() < 0.4 else a[: r.randrange(len(a) + 1)] + texts(r, r.randrange(9), alphabet) + a[r.randrange(len(a) + 1) :]
        assert similarity.ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert similarity.ratio(a, b) <= similarity.most_alike(a, b)


def test_long_texts_take_seconds():
    r = random.Random(4)
    a = texts(r, 200_000, "etaoinshrdlu   ")
    b = a[:70_000] + "changed" + a[70_500:150_000] + a[160_000:]
    n = similarity.matched(a, b)
    assert 70_000 + 79_500 + 40_000 <= n <= len(b) and similarity.ratio(a, a) == 1.0


def one_by_one(old, new, threshold):
    """The rule in a plain form: all pairs that are left, best first."""
    norm = lambda t: " ".join(t.lower().split())
    out, used_old, used_new = [], set(), set()
    for p, i, s, *_ in old:
        for q, j, z, *_ in new:
            if p == q and s == z:
                out.append((p, i, j, 1.0))
                used_old.add((p, i))
                used_new.add((p, j))
    found = []
    for p, i, _, t, x in old:
        for q, j, _, u, y in new:
            if p == q and (p, i) not in used_old and (p, j) not in used_new:
                a, b = norm(t), norm(u)
                score = 0.98 if a and a == b else round(0.7 * (difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0) + 0.3 * difflib.SequenceMatcher(None, norm(x), norm(y), autojunk=False).ratio(), 4)
                if score >= threshold:
                    found.append((-score, p, i, j))
    for score, p, i, j in sorted(found):
        if (p, i) not in used_old and (p, j) not in used_new:
            used_old.add((p, i))
            used_new.add((p, j))
            out.append((p, i, j, -score))
    return sorted(out)


@pytest.mark.parametrize(("threshold", "at_once"), [(0.64, diff.AT_ONCE), (0.64, 3), (0.3, 5), (0.0, diff.AT_ONCE), (0.98, 2), (0.99, 2)])
def test_match_equals_one_by_one(spark, threshold, at_once):
    r = random.Random(11)
    rows = []
    for side in "on":
        own = []
        for p in "ab":
            for i in range(9):
                title = r.choice(["", "Capital ratio", "Capital  RATIOS", "capital ratio s", "Liquidity", "Liquidity cover", "liquidity covers", "A much longer title about reporting to authorities, once", "A much longer title about reporting to authorities, twice"])
                own.append((p, i, f"{side if r.random() < 0.8 else ''}{i}", title, r.choice(["firms may report", "firms must report", "x", "", "all banks hold capital"])))
        rows.append(own)
    got = diff.match(spark.createDataFrame(rows[0], SECTION), spark.createDataFrame(rows[1], SECTION), threshold, at_once)
    assert sorted(map(tuple, got.collect())) == one_by_one(rows[0], rows[1], threshold)


def test_scores_above_and_at_that_of_equal_titles(spark):
    """A title of 99 characters that differs by one has a score over 0.98; the titles' own class loses a member to it."""
    long = "t" * 98
    old = [("a", 0, "o0", long + "x", "same"), ("a", 1, "o1", long + "y", "same"), ("a", 2, "o2", "u", "other")]
    new = [("a", 0, "n0", long + "y", "same"), ("a", 1, "n1", long + "z", "same"), ("a", 2, "n2", long + "y", "same")]
    got = diff.match(spark.createDataFrame(old, SECTION), spark.createDataFrame(new, SECTION))
    assert sorted(map(tuple, got.collect())) == one_by_one(old, new, diff.MATCH)


def test_large_pair_runs_in_many_tasks(spark):
    """One version pair; candidates and edges are rows of joins, and no task gets the pair's sections."""
    n = 1500
    rows = spark.range(n).select(F.lit("p").alias("pair_id"), F.col("id").alias("idx"), F.concat(F.lit("o"), "id").alias("section_id"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24).alias("title"), F.lit("text").alias("text"))
    other = rows.withColumns({"section_id": F.concat(F.lit("n"), "idx"), "title": F.concat("title", F.lit("z"))})
    got = diff.match(rows, other, 0.9, at_once=100)
    assert got.filter("old_idx = new_idx").count() == n == got.count()
    candidates = diff._candidates(rows.select("pair_id", F.col("idx").alias("old_idx"), "title"), other.select("pair_id", F.col("idx").alias("new_idx"), "title"), 0.85)
    assert candidates.count() < n * n // 20
