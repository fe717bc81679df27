"""A synthetic challenge set, its statistics and its rules: documents, queries, changes, sources and claims as tables.

The set is made by arithmetic on the topic's number; the wording is this engine's own. Every table has id, split, family_id,
and, but for documents and sources, difficulty; a topic is a family, and families do not cross splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "dev", "test")
LEVELS = ("easy", "medium", "hard")
STATUSES = ("supported", "partially_supported", "unsupported")
TOPICS = 30
#: Tags of which a set must have some case.
TAGS = ("hard_negative", "paraphrase_without_lexical_overlap", "section_renumbering")
COUNTED = {"documents": "documents", "queries": "retrieval_queries", "changes": "change_cases", "claims": "grounding_claims"}


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _said(pattern: str, *parts) -> Column:
    return F.format_string(pattern, *parts)


def topics(spark: SparkSession, n: int = TOPICS) -> DataFrame:
    """One row a topic: its split, its first article, its period in years and its interval in months."""
    i = F.col("i")
    rows = spark.range(n, numPartitions=1).select(F.col("id").cast("int").alias("i"))
    return rows.select(
        "i",
        _pick(SPLITS, F.floor(i * 3 / n)).alias("split"),
        _said("topic-%02d", i).alias("family_id"),
        _said("Directive %02d", i).alias("source"),
        (100 + 10 * i).alias("article"),
        (3 + i % 7).alias("years"),
        (3 * (1 + i % 4)).alias("months"),
    )


def tables(spark: SparkSession, n: int = TOPICS) -> dict[str, DataFrame]:
    t, i = topics(spark, n), F.col("i")
    keep = _said("Undertakings shall keep record series %02d for %d years.", i, "years")
    review = _said("The board reviews register %02d every %d months.", i, "months")
    notice = _said("Branch %02d reports a breach within %d days.", i, F.col("months") + 2)
    article = lambda k, body: F.concat(_said("Article %d - Part %d\n\n", F.col("article") + k, F.lit(k)), body)
    heading = _said("Records of area %02d", i)
    content = F.concat(F.lit("# "), heading, F.lit("\n\n"), article(1, keep), F.lit("\n\n"), article(2, review), F.lit("\n\n"), article(3, notice))
    documents = t.select(_said("doc-%02d", i).alias("id"), "split", "family_id", "source", content.alias("content"))

    number = lambda per, k: i * per + k
    cited = lambda k: F.concat("source", F.lit(" > "), heading, F.lit(" > "), _said("Article %d", F.col("article") + k))
    asked = [
        (_said("record series %02d kept for %d years", i, "years"), 1, "hard_negative"),
        (F.lit("archiving horizon of corporate files"), 1, "paraphrase_without_lexical_overlap"),
    ]
    queries = _union(
        t.select(_said(f"query-%02d-{k}", i).alias("id"), "split", "family_id", _pick(LEVELS, number(2, k)).alias("difficulty"), q.alias("question"), F.array(cited(part)).alias("relevant_citations"), F.array(F.lit(tag)).alias("challenge_tags"))
        for k, (q, part, tag) in enumerate(asked)
    )

    section = lambda name, text, version: F.struct(_said("law-%02d", i).alias("document_id"), name.alias("section_id"), F.lit("Duty").alias("title"), text.alias("text"), F.lit(version).alias("version"), F.lit(1).alias("page"))
    art, other = _said("art-%d", "article"), _said("art-%d", F.col("article") + 1)
    kind = i % 3
    should, must = _said("Undertakings should keep record series %02d.", i), _said("Undertakings must keep record series %02d.", i)
    none = F.lit(None)
    cases = [
        (F.lit(True), section(art, should, "1"), section(art, must, "2"), "modal_strengthening"),
        (
            F.lit(True),
            F.when(kind == 0, none).otherwise(section(art, keep, "1")),
            F.when(kind == 0, section(art, keep, "2")).when(kind == 1, none).otherwise(section(art, F.replace(keep, _said(" %d years", "years"), _said(" %d years", F.col("years") + 1)), "2")),
            "added_removed_or_numeric",
        ),
        (F.lit(False), section(art, review, "1"), section(other, review, "2"), "section_renumbering"),
        (F.lit(False), section(art, notice, "1"), section(art, F.concat(F.lit("  "), F.upper(notice)), "2"), "cosmetic"),
    ]
    changes = _union(
        t.select(_said(f"change-%02d-{k}", i).alias("id"), "split", "family_id", _pick(LEVELS, i + k).alias("difficulty"), material.alias("expected_material"), old.alias("previous"), new.alias("current"), F.array(F.lit(tag)).alias("challenge_tags"))
        for k, (material, old, new, tag) in enumerate(cases)
    )

    sources = t.select("split", "family_id", _said("evidence-%02d", i).alias("document_id"), F.lit("art-1").alias("section_id"), F.lit("").alias("title"), keep.alias("text"), F.lit("1").alias("version"), F.lit(1).alias("page"))
    quote = lambda text: F.struct(_said("evidence-%02d", i).alias("document_id"), F.lit("art-1").alias("section_id"), text.alias("quote"), F.lit("1").alias("version"), F.lit(1).alias("page"))
    right, wrong = quote(keep), quote(F.concat(keep, F.lit(" At once.")))

    def claim(k: int) -> DataFrame:
        status = _pick(STATUSES, number(2, k))
        quotes = F.when(status == STATUSES[0], F.array(right)).when(status == STATUSES[1], F.array(right, wrong)).otherwise(F.array(wrong))
        return t.select(_said(f"claim-%02d-{k}", i).alias("id"), "split", "family_id", _pick(LEVELS, number(2, k)).alias("difficulty"), keep.alias("text"), status.alias("expected_status"), quotes.alias("citations"))

    return {"documents": documents, "queries": queries, "changes": changes, "sources": sources, "claims": _union([claim(0), claim(1)])}


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def statistics(data: dict[str, DataFrame]) -> DataFrame:
    """(measure, value, n): all cases of each table, by split, by difficulty, and changes by materiality; one aggregate a table."""
    out = []
    for name, measure in COUNTED.items():
        df = data[name]
        key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
        keys = [key("all", F.lit("all")), key("split", F.col("split"))]
        keys += [key(kind, F.col(c)) for kind, c in (("difficulty", "difficulty"), ("material", "expected_material")) if c in df.columns]
        rows = df.select(F.explode(F.array(*keys)).alias("key"))
        out.append(rows.groupBy("key.kind", "key.value").agg(F.count("*").alias("n")).select(F.lit(measure).alias("measure"), "kind", "value", "n"))
    return _union(out)


def sections(documents: DataFrame) -> DataFrame:
    """(source, split, citation) of every article line below a heading."""
    rows = documents.select("source", "split", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    # the heading of a line: the last one above it, inside the document's own lines
    marked = rows.groupBy("source", "split").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    state = F.struct(F.lit(None).cast("string").alias("heading"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        line = x["line"]
        cited = F.concat_ws(" > ", s["heading"], F.split_part(line, F.lit(" - "), F.lit(1)))
        return F.struct(
            F.when(line.startswith("# "), F.substr(line, F.lit(3))).otherwise(s["heading"]).alias("heading"),
            F.when(F.lower(line).startswith("article "), F.concat(s["found"], F.array(cited))).otherwise(s["found"]).alias("found"),
        )

    return marked.select("source", "split", F.explode(F.aggregate("lines", state, step)["found"]).alias("_c")).select("source", "split", F.concat("source", F.lit(" > "), F.col("_c")).alias("citation"))


def violations(data: dict[str, DataFrame], manifest: DataFrame | None = None) -> DataFrame:
    """(rule, offender) of a challenge set. manifest(kind, split, id), if given, must name every case once, in its split."""
    d, q, c, s, g = (data[k] for k in ("documents", "queries", "changes", "sources", "claims"))
    rows = lambda df, rule, offender="id": df.select(F.lit(rule).alias("rule"), F.col(offender).cast("string").alias("offender"))
    named = _union(df.select(F.lit(k).alias("kind"), "id", "split", "family_id") for k, df in (("documents", d), ("queries", q), ("changes", c), ("claims", g)))
    own = named.select("kind", "id", "split", "family_id").filter(F.col("id").isNull() | F.col("family_id").isNull() | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))
    hard = _union(df.select("id", "difficulty") for df in (q, c, g)).filter(~F.coalesce(F.col("difficulty").isin(*LEVELS), F.lit(False)))
    known = sections(d)
    wanted = q.select("id", "split", F.explode("relevant_citations").alias("citation"))
    lost = wanted.join(known.select("citation"), "citation", "left_anti")
    crossing = wanted.withColumn("source", F.split_part("citation", F.lit(" > "), F.lit(1))).join(d.select("source", F.col("split").alias("_s")), "source").filter("split <> _s")
    cited = g.filter(F.col("expected_status") == STATUSES[0]).select("id", F.explode("citations").alias("x")).select("id", "x.document_id", "x.section_id")
    tags = _union([q.select(F.explode("challenge_tags").alias("tag")), c.select(F.explode("challenge_tags").alias("tag"))]).distinct()
    found = [
        rows(own, "missing_field"),
        rows(hard, "difficulty"),
        rows(named.groupBy("kind", "id").count().filter("count > 1"), "duplicate_id"),
        rows(q.filter(F.coalesce(F.size("relevant_citations"), F.lit(0)) <= 0), "no_judgment"),
        rows(lost.select("id").distinct(), "unknown_citation"),
        rows(crossing.select("id").distinct(), "crosses_splits"),
        rows(c.filter(F.col("previous").isNull() & F.col("current").isNull()), "no_sections"),
        rows(g.filter(~F.coalesce(F.col("expected_status").isin(*STATUSES), F.lit(False))), "expected_status"),
        rows(cited.join(s.select("document_id", "section_id"), ["document_id", "section_id"], "left_anti").select("id").distinct(), "unknown_source"),
        rows(named.groupBy("family_id").agg(F.count_distinct("split").alias("n")).filter("n > 1"), "family_leak", "family_id"),
        rows(d.sparkSession.createDataFrame([(t,) for t in TAGS], "tag string").join(tags, "tag", "left_anti"), "missing_tag", "tag"),
    ]
    if manifest is not None:
        twice = manifest.groupBy("kind", "id").count().filter("count > 1")
        placed = manifest.select("kind", "id", "split")
        found += [
            rows(named.select("kind", "id", "split").join(placed, ["kind", "id", "split"], "left_anti"), "not_in_manifest"),
            rows(placed.join(named.select("kind", "id", "split"), ["kind", "id", "split"], "left_anti"), "manifest_only"),
            rows(twice, "manifest_repeats"),
        ]
    return _union(found)


def as_document(data: dict[str, DataFrame]) -> dict:
    """The set in the published form of a benchmark: a few hundred rows, on the driver."""
    plain = {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in data.items()}
    for c in plain["claims"]:
        c["claim_id"] = c.pop("id")
    return {
        "schema_version": "2.0",
        "dataset": {"id": "arithmetic-challenge", "title": "Arithmetic challenge set", "version": "1", "provenance": {"kind": "synthetic", "disclaimer": "Made by arithmetic; no statement about any law."}},
        "retrieval": {"k": 5, "documents": plain["documents"], "queries": plain["queries"]},
        "changes": {"materiality_threshold": 0.35, "cases": plain["changes"]},
        "grounding": {"sources": plain["sources"], "claims": plain["claims"]},
    }
