import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone.functions import similarity
from lodestone.operators import diff, evidence

SECTION = "struct<document_id:string,section_id:string,title:string,text:string,version:string,page:int>"


def pairs(spark, rows):
    section = lambda text, version: None if text is None else ("d", "s", "t", text, version, 1)
    return spark.createDataFrame([(i, section(a, "1"), section(b, "2")) for i, (a, b) in enumerate(rows)], f"n int, previous {SECTION}, current {SECTION}")


def test_ratio_is_the_standard_librarys():
    rng = random.Random(3)
    for letters in ("ab", "abcde ", "abcdefghijklmnop "):
        for _ in range(200):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(2))
            at = rng.randint(0, len(a))
            for other in (b, a[:at] + b[:5] + a[at + 3 :]):
                assert similarity.ratio(a, other) == SequenceMatcher(None, a, other, autojunk=False).ratio()


def test_an_edited_line_needs_no_names(monkeypatch):
    monkeypatch.setattr(similarity, "_Names", None)
    rng = random.Random(4)
    line = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    for old, new in ((f"may pay {line}", f"must pay {line}"), (line, f"{line} within 30 days")):
        assert similarity.ratio(old, new) == SequenceMatcher(None, old, new, autojunk=False).ratio()


def test_scores_are_made_in_one_pass(spark):
    df = diff.changes(pairs(spark, [("it may pay", "it must pay"), ("same", "SAME"), (None, "it shall"), ("gone", None), ("", "")]))
    assert [r["similarity_score"] for r in df.orderBy("n").collect()] == [0.7619, 1.0, 0.0, 0.0, 1.0]
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_own_sections_are_reviewed_in_the_row(spark):
    df = evidence.self_review(diff.changes(pairs(spark, [("a", "b"), ("", "b"), (None, " "), ("a", "A"), (None, "x")]), False))
    assert [(r["n"], r["supported_citations"], r["unsupported_citations"], r["status"]) for r in df.orderBy("n").collect()] == [(0, 2, 0, "supported"), (1, 1, 1, "partially_supported"), (2, 0, 1, "unsupported"), (4, 1, 0, "supported")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
