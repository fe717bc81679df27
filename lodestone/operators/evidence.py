"""Evidence review: citations against exact source passages, claim status, and the accept or flag policy."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from lodestone.functions.text import normalise


#: Quotes of a source that stand in one row, about: a much-quoted source is searched in several tasks.
PER_ROW = 5_000
#: Quotes from which on an automaton is faster than looking for each one.
MANY = 8


def _present(text: Column, quotes: Column) -> Column:
    """Which of the quotes stand in the text: one automaton over all of them, one pass over the text."""

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, asked in zip(texts.to_pylist(), lists.to_pylist()):
            if t is None or len(asked) < MANY:
                out.append([t is not None and q in t for q in asked])
                continue
            automaton = ahocorasick.Automaton()
            for q in asked:
                automaton.add_word(q, q)
            automaton.make_automaton()
            seen = {q for _, q in automaton.iter(t)}
            out.append([q in seen for q in asked])
        return pa.array(out, pa.list_(pa.bool_()))

    return F.arrow_udf(run, ArrayType(BooleanType()))(text, quotes)


def citation_support(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations(citation_id, source_id, quote, version, page) against sources(source_id, text, version, page).

    A version or page that the citation names must be equal in the source; the normalised quote must stand in it; any of
    several sources under one id will do. Equal citations count each. A source's text meets all its quotes in one row, and is
    passed once for all of them.
    """
    s = sources.select("source_id", normalise("text").alias("_text"), F.col("version").alias("_version"), F.col("page").alias("_page"))
    names = ("source_id", "_quote", "version", "page")
    c = citations.withColumn("_quote", normalise("quote"))
    asked = c.select(*names).filter("_quote <> ''").distinct()
    # quotes of a source in as many rows as it takes
    rows = asked.groupBy("source_id").agg(F.ceil(F.count("*") / PER_ROW).alias("_rows"))
    row = F.pmod(F.xxhash64("_quote"), F.col("_rows")).alias("_nth")
    grouped = asked.join(rows, "source_id").groupBy("source_id", row).agg(F.collect_list(F.struct(*names[1:])).alias("_asked"))
    met = s.join(grouped, "source_id").withColumn("_there", _present(F.col("_text"), F.transform("_asked", lambda q: q["_quote"])))
    hits = met.select("source_id", "_version", "_page", F.explode(F.arrays_zip("_asked", "_there")).alias("h")).filter("h._there").select("source_id", "_version", "_page", "h._asked.*")
    same = lambda name: F.col(name).isNull() | F.coalesce(F.col(name) == F.col(f"_{name}"), F.lit(False))
    right = hits.filter(same("version") & same("page")).select(*names).distinct()
    right = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], F.lit(True).alias("supported"))
    fits = reduce(lambda x, n: x & F.col(n).eqNullSafe(F.col(f"_r_{n}")), names[1:], F.col("source_id") == F.col("_r_source_id"))
    return c.join(right, fits, "left").select(*citations.columns, F.coalesce("supported", F.lit(False)).alias("supported"))


def review(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """claims(claim_id) with checked(claim_id, supported): counts, status, reason; claims without citations stay."""
    n = checked.groupBy("claim_id").agg(F.count_if("supported").alias("supported_citations"), F.count_if(~F.col("supported")).alias("unsupported_citations"))
    return with_status(claims.join(n, "claim_id", "left").fillna(0, ["supported_citations", "unsupported_citations"]))


def with_status(out: DataFrame) -> DataFrame:
    """Status and reason by supported_citations and unsupported_citations."""
    yes, no = F.col("supported_citations"), F.col("unsupported_citations")
    status = F.when((yes > 0) & (no == 0), "supported").when(yes > 0, "partially_supported").otherwise("unsupported")
    # fixed values: the sentences are part of the result
    reason = (
        F.when((yes > 0) & (no == 0), "Every citation resolves to an exact passage in its source.")
        .when(yes > 0, "At least one citation could not be verified against its source.")
        .when(no == 0, "The claim has no citation.")
        .otherwise("No citation could be verified against its source.")
    )
    return out.withColumns({"status": status, "reason": reason})


def self_review(changes: DataFrame) -> DataFrame:
    """changes(change_id, claim_id, previous, current): the review of each change's claim against the change's own sections.

    A claim cites the sections it has, each with its whole text; changes without a claim have no review. Such a quote stands in its
    own section, whose version and page it names, unless nothing is left of it when it is normalised: so a change is one row, no
    quote is looked up elsewhere, and the change's own columns are kept.
    """
    made = changes.filter(F.col("claim_id").isNotNull())
    quoted = [F.when(F.col(s).isNotNull(), F.coalesce(normalise(F.col(f"{s}.text")) != "", F.lit(False))) for s in ("previous", "current")]
    made = made.select(*[c for c in changes.columns if c not in ("previous", "current")], F.array_compact(F.array(*quoted)).alias("_quoted"))
    n = lambda which: F.size(F.filter("_quoted", which)).cast("long")
    return with_status(made.withColumns({"supported_citations": n(lambda x: x), "unsupported_citations": n(lambda x: ~x)}).drop("_quoted"))


def policy(reviews: DataFrame, remove_unsupported: bool = True) -> DataFrame:
    ok = F.col("status") == "supported"
    return reviews.withColumns({"accepted": ok | F.lit(not remove_unsupported), "flagged": ~ok})


def sources_from_map(sources: DataFrame, column: str = "sources") -> DataFrame:
    """A map column of 'document:section' to text as source rows; an error for a key without a colon."""
    rows = sources.select(F.explode(column).alias("key", "text"))
    parts = F.split("key", ":", 2)
    section = F.when(F.size(parts) == 2, parts[1]).otherwise(F.raise_error(F.lit("a source id must be document:section")).cast("string"))
    return rows.select(F.concat(parts[0], F.lit(":"), section).alias("source_id"), "text", F.lit(None).cast("string").alias("version"), F.lit(None).cast("int").alias("page"))
