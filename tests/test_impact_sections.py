import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import concepts
from lodestone.operators import diff, impact
from lodestone.plans import catalogue

SECTION = "document_id string, section_id string, title string, text string, version string, page int"
ITEM = f"item_id int, name string, keywords array<string>, source struct<{SECTION.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>"


def sections(spark, rng, version):
    word = lambda n: f"word{min(rng.randrange(n), rng.randrange(n))}"
    rows = [(p, i, f"d{p}", f"s{rng.randrange(12)}{'' if rng.random() < 0.6 else version}-{i}", rng.choice(["T", "t ", "U", "", None, "V w"]), rng.choice([None, ""]) if rng.random() < 0.1 else " ".join(word(40) for _ in range(rng.randrange(25))), version, i) for p in [*range(6), None] for i in range(rng.randrange(12))]
    return spark.createDataFrame(rows, f"pair_id int, idx long, {SECTION}").repartition(3)


def items(spark, rng):
    rows = [(i, f"Item {i}", [f"word{rng.randrange(40)}" for _ in range(rng.randrange(12))], ("x", f"i{i}", "", "Own text", "1", 1) if i % 3 == 0 else None) for i in range(50)]
    return spark.createDataFrame([*rows, (None, "word1", None, None), (77, None, None, None)], ITEM)


def rows(df):
    return sorted(map(str, df.select("change_id", "rank", "item_id", "relevance_score", "confidence_score", "rationale", "claim_id", "claim_text", "citations").collect()))


def ranked(spark, seed):
    rng = random.Random(seed)
    old, new = sections(spark, rng, "1"), sections(spark, rng, "2")
    return old, new, diff.match_exact(old, new), items(spark, rng)


@pytest.mark.parametrize("minimum", [0, 0.2])
@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_sections_have_the_impacts_of_their_changes(spark, monkeypatch, minimum, sent):
    for name, n in (("CANDIDATES", 30), ("COUNTED", 100), ("SENT", sent)):
        monkeypatch.setattr(impact, name, n)
    old, new, matches, c = ranked(spark, 4)
    changes = diff.changes(diff.aligned(old, new, matches), False)
    got = rows(impact.assessments_of(old, new, matches, c, minimum))
    assert got and got == rows(impact.assessments(changes, c, minimum))
    assert got[:1] != got[-1:] and rows(impact.assessments(changes, c.limit(0), minimum)) == rows(impact.assessments(changes.limit(0), c, minimum)) == []


def test_ranks_and_rationales_are_those_of_impacts(spark):
    old, new, matches, c = ranked(spark, 5)
    changes = diff.changes(diff.aligned(old, new, matches), False)
    text = changes.select("change_id", F.coalesce("current", "previous")["text"].alias("text"))
    want = defaultdict(list)
    for r in impact.impacts(text, c.withColumn("has_source", F.col("source").isNotNull())).collect():
        want[r["change_id"]].append((-r["relevance_score"], r["item_id"], r["rationale"], r["confidence_score"], r["claim_id"], r["claim_text"]))
    got = defaultdict(list)
    for r in impact.assessments_of(old, new, matches, c).orderBy("rank").collect():
        got[r["change_id"]].append((-r["relevance_score"], r["item_id"], r["rationale"], r["confidence_score"], r["claim_id"], r["claim_text"]))
        assert r["rank"] == len(got[r["change_id"]]) and [x["quote"] for x in r["citations"][1:]] == ["Own text"] * (r["item_id"] % 3 == 0)
    assert got and got == {k: sorted(v) for k, v in want.items()}


def test_matches_are_those_taken_one_by_one(spark):
    old, new, matches, _ = ranked(spark, 6)
    o, n = (sorted((r["pair_id"], r["idx"], r["section_id"], " ".join((r["title"] or "").lower().split())) for r in df.filter("pair_id is not null").collect()) for df in (old, new))
    want = [(x[0], x[1], y[1], 1.0) for x in o for y in n if (x[0], x[2]) == (y[0], y[2])]
    done = {("o", p, i) for p, i, _, _ in want} | {("n", p, j) for p, _, j, _ in want}
    for x in o:
        y = next((y for y in n if x[3] and (x[0], x[3]) == (y[0], y[3]) and ("n", *y[:2]) not in done), None)
        if y and ("o", *x[:2]) not in done:
            want.append((x[0], x[1], y[1], 0.98))
            done |= {("o", *x[:2]), ("n", *y[:2])}
    assert {x[3] for x in want} == {1.0, 0.98} and sorted(map(tuple, matches.collect())) == sorted(want)


def test_results_are_not_shuffled_and_documents_read_few_times(spark, tmp_path):
    spark.createDataFrame([(i, "capital ratio of the bank\nliquidity ratio\nnothing here\nother") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "capital ratio"), (2, "liquidity")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = catalogue.QUERIES["impact_assessments"](spark, str(tmp_path))
    assert len(df.collect()) > 20
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(change_id" not in final and "hashpartitioning(item_id" not in final
    assert final.count("ReadSchema: struct<doc_id:") <= 4 and final.count("ArrowEvalPython") <= 3


def test_concepts_have_three_characters_between_their_ends(spark):
    got = spark.createDataFrame([("ab a- --ab' a'b -Abc-- ẞö GROẞ Groß the", None)], "t string, n string").select(concepts(F.col("t")), concepts(F.col("n"))).first()
    assert got[0] == ["a'b", "abc", "gross"] and got[1] is None
