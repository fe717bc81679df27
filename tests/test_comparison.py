import pytest
from pyspark.sql import functions as F

from lodestone.operators import diff, evidence, impact

SECTION = "pair_id string, idx long, document_id string, section_id string, title string, text string, version string, page int"


def sections(spark, rows, version):
    return spark.createDataFrame([("p", i, "d", s, t, x, version, 1) for i, (s, t, x) in enumerate(rows)], SECTION)


def compared(spark, old, new):
    o, n = sections(spark, old, "1"), sections(spark, new, "2")
    return diff.changes(diff.aligned(o, n, diff.match(o, n))).orderBy("bucket", "idx").collect()


def test_types_signals_and_scores(spark):
    rows = compared(
        spark,
        [("1", "Reporting", "Firms should report."), ("2", "Scope", "All  firms."), ("3", "Old", "Gone text.")],
        [("1", "Reporting", "Firms must report."), ("2", "Scope", "all firms."), ("4", "Fresh and other", "Firms shall file.")],
    )
    assert [r["change_type"] for r in rows] == ["modified", "unchanged", "removed", "added"]
    assert rows[0]["signals"] == ["obligation_strengthened", "binding_language_added"] and rows[0]["materiality"] == "high" and rows[0]["materiality_score"] >= 0.9
    assert rows[0]["claim_text"] == "The obligation in section 1 has been strengthened."
    assert (rows[1]["materiality_score"], rows[1]["confidence_score"], rows[1]["claim_id"]) == (0, 1, None)
    assert (rows[2]["materiality_score"], rows[3]["materiality_score"], rows[3]["confidence"]) == (0.5, 0.75, "high")
    assert rows[2]["signals"] == ["removed_section"] and rows[3]["signals"] == ["new_section"]


def test_titles_match_where_ids_differ(spark):
    rows = compared(spark, [("a", "Model Risk", "Review in 5 days.")], [("b", "model risk", "Review in 7 months.")])
    assert [r["change_type"] for r in rows] == ["modified"]
    assert rows[0]["signals"] == ["deadline_language_changed", "numeric_threshold_changed"]
    assert rows[0]["confidence_score"] == pytest.approx(min(0.99, 0.75 * 0.94 + 0.25 * max(rows[0]["similarity_score"], 0.5)), abs=1e-4)


def test_fuzzy_titles_and_greedy_order(spark):
    o = sections(spark, [("a", "Capital ratio", "x y z"), ("b", "Capital ratios", "x y z")], "1")
    n = sections(spark, [("c", "Capital ratios", "x y z"), ("d", "Capital ratioz", "x y z")], "2")
    got = {(r["old_idx"], r["new_idx"]): r["match_score"] for r in diff.match(o, n).collect()}
    best = sorted(((-diff.section_match_score(*a, *b), i, j) for i, a in enumerate([("capital ratio", "x y z"), ("capital ratios", "x y z")]) for j, b in enumerate([("capital ratios", "x y z"), ("capital ratioz", "x y z")])))
    assert (best[0][1], best[0][2]) in got and len(got) == 2


def test_ratio_is_not_symmetric():
    assert diff.ratio("tide", "diet") == 0.25 and diff.ratio("diet", "tide") == 0.5


def test_exact_alignment_agrees_with_one_by_one(spark):
    o = sections(spark, [("1", "T", "a"), ("2", "T", "b"), ("3", "U", "c")], "1")
    n = sections(spark, [("9", "t", "a"), ("8", "T ", "b"), ("3", "V", "c")], "2")
    assert {(r["old_idx"], r["new_idx"]) for r in diff.match_exact(o, n).collect()} == {(0, 0), (1, 1), (2, 2)}
    assert {(r["old_idx"], r["new_idx"]) for r in diff.match(o, n).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_evidence(spark):
    s = spark.createDataFrame([("d:1", "Firms must  report Annually.", "2", 4), ("d:1", "Other text", None, 4)], "source_id string, text string, version string, page int")
    rows = [("a", "d:1", "must report annually", None, None), ("b", "d:1", "must report monthly", None, None), ("c", "d:1", "must report", "1", None), ("d", "d:1", "other", "2", None), ("e", "d:9", "x", None, None), ("f", "d:1", " ", None, None), ("g", "d:1", "must report", "2", 4), ("g", "d:9", "must report", "2", 4)]
    cited = spark.createDataFrame(rows, "claim_id string, source_id string, quote string, version string, page int")
    checked = evidence.citation_support(cited, s)
    claims = spark.createDataFrame([(c,) for c in "abcdefgh"], "claim_id string")
    got = {r["claim_id"]: r for r in evidence.policy(evidence.review(claims, checked)).collect()}
    assert {c: r["status"] for c, r in got.items()} == {"a": "supported", "g": "partially_supported"} | dict.fromkeys("bcdefh", "unsupported")
    assert got["h"]["reason"] == "The claim has no citation." and got["a"]["accepted"] and got["g"]["flagged"]
    assert evidence.policy(evidence.review(claims, checked), remove_unsupported=False).filter("accepted").count() == 8


def test_impact(spark):
    changed = spark.createDataFrame([("c", "The model inventory and its controls must be reviewed.")], "change_id string, text string")
    items = spark.createDataFrame([("POL-1", "Model policy", ["model", "controls"], True), ("POL-2", "Travel", ["travel", "expenses"], False), ("POL-3", "Model inventory list", [], False)], "item_id string, name string, keywords array<string>, has_source boolean")
    got = {r["item_id"]: r for r in impact.impacts(changed, items).collect()}
    assert set(got) == {"POL-1", "POL-3"} and got["POL-1"]["relevance_score"] == 1 and got["POL-1"]["confidence_score"] == 0.98
    assert "controls, model" in got["POL-1"]["rationale"] and got["POL-3"]["relevance_score"] == 0.6667
    assert impact.impacts(changed, items, 0).count() == 3
    with pytest.raises(ValueError):
        impact.impacts(changed, items, 2)


def test_equal_citations_count_each_and_many_quotes_meet_one_source(spark):
    import random

    rng = random.Random(5)
    text = "".join(rng.choice("abc  ") for _ in range(20_000))
    s = spark.createDataFrame([("d:1", text, "1", 1), ("d:2", "short text", None, None)], "source_id string, text string, version string, page int")
    quotes = [text[(at := rng.randrange(19_000)) : at + rng.randint(1, 30)] for _ in range(3000)] + ["".join(rng.choice("abc ") for _ in range(14)) for _ in range(3000)]
    rows = [(i, "d:1", q, None, None) for i, q in enumerate(quotes)] + [(7000, "d:2", "Short", None, None)] * 3 + [(7001, "d:2", "long", None, None)] * 2
    got = evidence.citation_support(spark.createDataFrame(rows, "claim_id int, source_id string, quote string, version string, page int"), s).collect()
    flat = " ".join(text.split())
    want = sorted([(i, " ".join(q.split()) != "" and " ".join(q.split()) in flat) for i, q in enumerate(quotes)] + [(7000, True)] * 3 + [(7001, False)] * 2)
    assert sorted((r["claim_id"], r["supported"]) for r in got) == want


@pytest.mark.parametrize("minimum", [0.2, 0.3333, 0.5, 1.0])
def test_impacts_equal_all_pairs(spark, minimum):
    """The prefix of rare concepts loses no pair, also where rounding lifts a score to the minimum."""
    import random

    rng = random.Random(8)
    word = lambda: f"word{min(rng.randrange(40), rng.randrange(40))}"
    changes = [(i, [word() for _ in range(rng.randrange(12))]) for i in range(60)]
    items = [(i, [word() for _ in range(rng.randint(1, 12))]) for i in range(40)]
    got = impact.impacts(
        spark.createDataFrame([(i, " ".join(w)) for i, w in changes], "change_id int, text string"),
        spark.createDataFrame([(i, f"Item {i}", w, False) for i, w in items], "item_id int, name string, keywords array<string>, has_source boolean"), minimum,
    )
    want = sorted((c, i, score) for c, w in changes for i, k in items if set(w) & set(k) and (score := round(len(set(w) & set(k)) / len(set(k)), 4)) >= minimum)
    assert sorted((r["change_id"], r["item_id"], r["relevance_score"]) for r in got.collect()) == want


def test_duplicates_and_shapes(spark):
    s = sections(spark, [("1", "", "a"), ("1", "", "b")], "1")
    assert diff.duplicates(s).count() == 1
    o, n = sections(spark, [("1", "", "a")], "1"), sections(spark, [("1", "", "a")], "2")
    bad = diff.changes(diff.aligned(o, n, diff.match(o, n)), False).withColumn("change_type", F.lit("added"))
    assert diff.shape_violations(bad).count() == 1
