"""Version comparison: section alignment, change types, signals, scores, claims.

Sections are rows (pair_id, side columns …). Alignment by section id and by title are equi-joins; what they leave meets in an
inverted index on the characters of titles, is scored by the similarity ratio, and is taken greedily in rounds over edges.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lodestone.functions.similarity import at_most, most_alike, ratio
from lodestone.functions.steps import checkpointed, written
from lodestone.functions.text import digest, normalise, words_of

#: Modal strengths and the word lists behind signals.
MODALS = {"may": 0, "can": 0, "could": 0, "should": 1, "shall": 2, "must": 3}
REQUIREMENTS = ["must", "shall", "required", "prohibited", "ensure"]
DEADLINES = ["day", "days", "month", "months", "annual", "annually", "immediately"]
MATCH = 0.64
#: What equal titles score; what rounding a score to four digits may add to it; edges of a version pair that a task takes at once.
SAME_TITLE, SLACK, AT_ONCE = 0.98, 1e-4, 200_000


def duplicates(sections: DataFrame) -> DataFrame:
    return sections.groupBy("document_id", "section_id").agg(F.count("*").alias("n")).filter("n > 1")


def _ratios(old: str, new: str) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(ratio(x or "", y or ""), 4) for x, y in zip(a, b)], dtype=float)

    return F.pandas_udf(run, "double")(old, new)


def match_exact(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, old_idx, new_idx, match_score): equal section ids first, then equal titles, the k-th with the k-th.

    Within a title, pairing in order of both sides is what taking pairs one by one in that order gives. Each side is read once:
    an outer join by id leaves what has no match, which goes on by title in the same rows.
    """
    side = lambda df, name: df.select("pair_id", "section_id", F.col("idx").alias(f"{name}_idx"), normalise("title").alias(f"{name}_title"))
    by_id = side(old, "old").join(side(new, "new"), ["pair_id", "section_id"], "full_outer")
    kind = F.when(F.col("old_idx").isNull(), "new").when(F.col("new_idx").isNull(), "old").otherwise("both")
    # matches by id stay apart: they keep their ids for a title, and each is a group of its own
    key = F.when(F.col("kind") == "both", F.col("section_id")).otherwise(F.coalesce("old_title", "new_title"))
    rows = by_id.withColumn("kind", kind).select("pair_id", "old_idx", "new_idx", "kind", key.alias("key"))
    rows = rows.filter((F.col("kind") == "both") | ((F.col("key") != "") & F.col("pair_id").isNotNull())).repartition("pair_id", "key")
    nth = F.row_number().over(Window.partitionBy("pair_id", "key", "kind").orderBy("old_idx", "new_idx"))
    met = rows.withColumn("k", nth).groupBy("pair_id", "key", "k", (F.col("kind") == "both").alias("same")).agg(F.max("old_idx").alias("old_idx"), F.max("new_idx").alias("new_idx"))
    return met.filter("old_idx is not null and new_idx is not null").select("pair_id", "old_idx", "new_idx", F.when(F.col("same"), 1.0).otherwise(SAME_TITLE).alias("match_score"))


def section_match_score(old_title: str, old_text: str, new_title: str, new_text: str, threshold: float = 0.0) -> float:
    """Of sections with different ids; titles and texts normalised. 0 for what cannot reach the threshold."""
    if old_title and old_title == new_title:
        return SAME_TITLE
    title = ratio(old_title, new_title) if old_title and new_title else 0.0
    if 0.7 * title + 0.3 * most_alike(old_text, new_text) < threshold - SLACK:
        return 0.0
    return round(0.7 * title + 0.3 * ratio(old_text, new_text), 4)


def _dealt(df: DataFrame) -> DataFrame:
    """By version pair, over all the tasks there are: few bytes can be much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id")


def _characters(title: Column) -> Column:
    """A title's characters, each with its number among equal ones, as one number: as sets they share what the titles share as multisets.

    Characters that are rare in most texts come first: later ones of equals, then those far up in the code table.
    """

    def numbered(text: str) -> list[int]:
        seen: Counter = Counter()
        out = []
        for c in text:
            seen[c] += 1
            out.append(seen[c] << 21 | ord(c))
        return sorted(out, reverse=True)

    def run(titles: pa.Array) -> pa.Array:
        return pa.array([None if t is None else numbered(t) for t in titles.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(run, ArrayType(LongType()))(title)


def _prefix(side: str, least: float) -> Column:
    n = F.length(f"{side}_title")
    return F.slice(f"{side}_all", 1, n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1)


def _met(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """Pairs that meet in an inverted index on characters, for version pairs of any size.

    Titles of la and lb characters with that ratio share least * (la + lb) / 2 of them, so they meet in a prefix of each one's
    characters in a fixed order; a pair is taken where its first common character meets. No pair that can match is left out.
    """
    sides = [df.withColumn(f"{side}_all", _characters(F.col(f"{side}_title"))).withColumn("character", F.explode(_prefix(side, least))) for df, side in ((old, "old"), (new, "new"))]
    met = sides[0].join(sides[1], ["pair_id", "character"]).filter("old_title <> new_title")
    first = F.element_at(F.array_intersect(_prefix("old", least), _prefix("new", least)), 1) == F.col("character")
    enough = F.size(F.array_intersect("old_all", "new_all")) >= (F.size("old_all") + F.size("new_all")) * (least / 2) - 1e-9
    return met.filter(first & enough)


def _candidates(old: DataFrame, new: DataFrame, least: float, at_once: int = AT_ONCE) -> DataFrame:
    """(pair_id, old_idx, new_idx, old_title, new_title) of sections with different titles whose ratio may reach `least`.

    A version pair of at most `at_once` pairs of sections makes them all in one task, from rows that are shuffled once; others
    meet in an index. With least <= 0 titles rule out nothing, and all pairs are candidates.
    """
    columns = ("pair_id", "old_idx", "new_idx", "old_title", "new_title")
    o, n = (df.select("pair_id", f"{side}_idx", F.col("title").alias(f"{side}_title")) for df, side in ((old, "old"), (new, "new")))
    if least <= 0:
        return o.join(n, "pair_id").filter("old_title <> new_title or old_title = ''").select(*columns)
    o, n = o.filter("old_title <> ''"), n.filter("new_title <> ''")
    size = lambda df, name: df.groupBy("pair_id").agg(F.count("*").alias(name))
    many = checkpointed(size(o, "_o").join(size(n, "_n"), "pair_id").filter(F.col("_o") * F.col("_n") > at_once).select("pair_id"))
    la, lb = F.length("old_title"), F.length("new_title")
    near = F.least(la, lb) >= (la + lb) * (least / 2) - 1e-9
    few = _dealt(o.join(many, "pair_id", "left_anti")).join(_dealt(n).hint("merge"), "pair_id").filter((F.col("old_title") != F.col("new_title")) & near).select(*columns)
    if many.isEmpty():
        return few
    return few.union(_met(o.join(many, "pair_id", "left_semi"), n.join(many, "pair_id", "left_semi"), least).select(*columns))


def _edges(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """(pair_id, old_idx, new_idx, score) of sections with different titles that reach the threshold."""
    least = (threshold - SLACK - 0.3) / 0.7
    found = _candidates(old, new, least)

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) if x and y and at_most(x, y) >= least else 0.0 for x, y in zip(a, b)], dtype=float)

    found = found.withColumn("title_ratio", F.pandas_udf(alike, "double")("old_title", "new_title")).filter(F.col("title_ratio") >= least).drop("old_title", "new_title")
    texts = found.join(old.select("pair_id", "old_idx", F.col("text").alias("old_text")), ["pair_id", "old_idx"]).join(new.select("pair_id", "new_idx", F.col("text").alias("new_text")), ["pair_id", "new_idx"])

    def scored(title: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        at_best = [0.7 * t + 0.3 * most_alike(x, y) for t, x, y in zip(title, a, b)]
        return pd.Series([round(0.7 * t + 0.3 * ratio(x, y), 4) if m >= threshold - SLACK else 0.0 for m, t, x, y in zip(at_best, title, a, b)], dtype=float)

    score = F.pandas_udf(scored, "double")("title_ratio", "old_text", "new_text")
    return texts.select("pair_id", "old_idx", "new_idx", score.alias("score")).filter(F.col("score") >= threshold)


def greedy(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Of edges(pair_id, old_idx, new_idx, score) those that are taken one by one, best score first, then smallest old_idx and new_idx.

    An edge that is the best one of both its ends is taken whatever happens elsewhere, so a round takes all of these and drops
    the other edges of their ends, until none is left. A version pair with at most `at_once` edges is finished in one task.
    """
    kind, taken, left = edges.schema["pair_id"].dataType.simpleString(), [], edges
    schema = f"pair_id {kind}, old_idx long, new_idx long, score double"

    def finish(batches):
        pair, old, new = None, set(), set()
        for batch in batches:
            keep = []
            for p, i, j in zip(*(batch.column(c).to_pylist() for c in ("pair_id", "old_idx", "new_idx"))):
                if p != pair:
                    pair, old, new = p, set(), set()
                keep.append(i not in old and j not in new)
                if keep[-1]:
                    old.add(i)
                    new.add(j)
            yield batch.filter(pa.array(keep, pa.bool_()))

    while True:
        n = left.groupBy("pair_id").agg(F.count("*").alias("n"))
        few = left.join(n.filter(F.col("n") <= at_once).select("pair_id"), "pair_id", "left_semi").select("pair_id", "old_idx", "new_idx", "score")
        taken.append(_dealt(few).sortWithinPartitions("pair_id", F.desc("score"), "old_idx", "new_idx").mapInArrow(finish, schema))
        many = n.filter(F.col("n") > at_once).select("pair_id")
        if many.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        best = lambda end, other: F.row_number().over(Window.partitionBy("pair_id", end).orderBy(F.desc("score"), other)) == 1
        ranked = checkpointed(left.join(many, "pair_id", "left_semi").withColumns({"_o": best("old_idx", "new_idx"), "_n": best("new_idx", "old_idx")}))
        chosen = ranked.filter("_o and _n").drop("_o", "_n")
        taken.append(chosen)
        ends = chosen.select("pair_id", "old_idx", "new_idx")
        rest = ranked.drop("_o", "_n").join(ends.drop("new_idx"), ["pair_id", "old_idx"], "left_anti").join(ends.drop("old_idx"), ["pair_id", "new_idx"], "left_anti")
        left = checkpointed(rest.select(*edges.columns))


def _free(df: DataFrame, side: str, taken: DataFrame) -> DataFrame:
    return df.join(taken.select("pair_id", f"{side}_idx"), ["pair_id", f"{side}_idx"], "left_anti")


def _by_title(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """What is taken among sections with equal titles and edges of the same score: the k-th with the k-th within a title.

    Titles whose sections have such an edge are taken edge by edge.
    """
    o, n = (df.filter("title <> ''").select("pair_id", f"{side}_idx", "title") for df, side in ((old, "old"), (new, "new")))
    touched = edges.join(o, ["pair_id", "old_idx"]).select("pair_id", "title").union(edges.join(n, ["pair_id", "new_idx"]).select("pair_id", "title")).distinct()
    mixed = o.join(touched, ["pair_id", "title"], "left_semi").join(n, ["pair_id", "title"]).select("pair_id", "old_idx", "new_idx", F.lit(SAME_TITLE).alias("score"))
    nth = lambda df, side: df.join(touched, ["pair_id", "title"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("pair_id", "title").orderBy(f"{side}_idx")))
    plain = nth(o, "old").join(nth(n, "new"), ["pair_id", "title", "k"]).select("pair_id", "old_idx", "new_idx", F.lit(SAME_TITLE).alias("score"))
    return plain.unionByName(greedy(checkpointed(mixed.unionByName(edges))))


def match(old: DataFrame, new: DataFrame, threshold: float = MATCH, at_once: int = AT_ONCE) -> DataFrame:
    """(pair_id, old_idx, new_idx, match_score): one to one, equal section ids first, then best score first, then input order.

    Sections are rows at every step: no version pair is gathered in a task beyond at_once scored edges.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    side = lambda df, name: df.select("pair_id", F.col("idx").cast("long").alias(f"{name}_idx"), "section_id", normalise("title").alias("title"), normalise("text").alias("text"))
    o, n = side(old, "old"), side(new, "new")
    by_id = o.select("pair_id", "old_idx", "section_id").join(n.select("pair_id", "new_idx", "section_id"), ["pair_id", "section_id"]).select("pair_id", "old_idx", "new_idx", F.lit(1.0).alias("match_score"))
    o, n = (written(_free(df, name, by_id).drop("section_id")) for df, name in ((o, "old"), (n, "new")))
    edges = checkpointed(_edges(o, n, threshold))
    named = threshold <= SAME_TITLE
    above, tied = edges.filter(F.col("score") > SAME_TITLE), edges.filter(F.col("score") == SAME_TITLE)
    taken = [checkpointed(greedy(above if named else edges, at_once))]
    if named:
        free = lambda df: reduce(lambda d, t: _free(_free(d, "old", t), "new", t), taken, df)
        taken.append(checkpointed(_by_title(_free(o, "old", taken[0]), _free(n, "new", taken[0]), free(tied))))
        taken.append(greedy(checkpointed(free(edges.filter(F.col("score") < SAME_TITLE))), at_once))
    return by_id.unionByName(reduce(DataFrame.unionByName, taken).withColumnRenamed("score", "match_score"))


def aligned(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches, then removed, then added sections: pair_id, position bucket, previous and current as structs."""
    side = lambda df: F.struct(*[c for c in df.columns if c not in ("pair_id", "idx")])
    o = old.select("pair_id", F.col("idx").cast("long").alias("old_idx"), side(old).alias("previous"))
    n = new.select("pair_id", F.col("idx").cast("long").alias("new_idx"), side(new).alias("current"))
    m = matches.select("pair_id", F.col("old_idx").cast("long"), F.col("new_idx").cast("long"))
    both = m.join(o, ["pair_id", "old_idx"]).join(n, ["pair_id", "new_idx"]).select("pair_id", F.lit(0).alias("bucket"), F.col("old_idx").alias("idx"), "previous", "current")
    gone = o.join(m, ["pair_id", "old_idx"], "left_anti").select("pair_id", F.lit(1).alias("bucket"), F.col("old_idx").alias("idx"), "previous", F.lit(None).alias("current"))
    come = n.join(m, ["pair_id", "new_idx"], "left_anti").select("pair_id", F.lit(2).alias("bucket"), F.col("new_idx").alias("idx"), F.lit(None).alias("previous"), "current")
    return both.unionByName(gone).unionByName(come)


def _signals(old: Column, new: Column) -> tuple[Column, Column, Column, Column, Column]:
    """strengthened, weakened, binding added, deadline changed, numbers changed, of word arrays."""
    count = lambda w, m: F.size(F.filter(w, lambda x: x == m))
    # one struct a modal, so each count is written once
    dropped = F.array_compact(F.array(*[F.when(count(old, m) > count(new, m), F.lit(s)) for m, s in MODALS.items()]))
    raised = F.array_compact(F.array(*[F.when(count(new, m) > count(old, m), F.lit(s)) for m, s in MODALS.items()]))
    stronger = F.coalesce(F.array_max(raised) > F.array_min(dropped), F.lit(False))
    weaker = F.coalesce(F.array_min(raised) < F.array_max(dropped), F.lit(False))
    lit = lambda ws: F.array(*map(F.lit, ws))
    binding = F.arrays_overlap(new, lit(REQUIREMENTS)) & ~F.arrays_overlap(old, lit(REQUIREMENTS))
    deadline = F.arrays_overlap(F.array_union(F.array_except(old, new), F.array_except(new, old)), lit(DEADLINES))
    numbers = lambda w: F.array_sort(F.array_distinct(F.filter(w, lambda x: x.rlike(r"^\d+$"))))
    return stronger, weaker, binding, deadline, numbers(old) != numbers(new)


def _level(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def source_id(s: Column) -> Column:
    return F.concat(s["document_id"], F.lit(":"), s["section_id"])


def change_id(old_source: Column, old_version: Column, new_source: Column, new_version: Column) -> Column:
    return F.concat(F.lit("change-"), digest(12, "|", F.coalesce(old_source, F.lit("-")), old_version, F.coalesce(new_source, F.lit("-")), new_version))


def changes(pairs: DataFrame, with_similarity: bool = True) -> DataFrame:
    """One change for each row of aligned(); without similarity the scores that need it are left out."""
    p, c = F.col("previous"), F.col("current")
    base = pairs.withColumns({"_old": normalise(p["text"]), "_new": normalise(c["text"])})
    base = base.withColumns({"_ow": words_of("_old"), "_nw": words_of("_new")})
    kind = F.when(p.isNull(), "added").when(c.isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("modified")
    stronger, weaker, binding, deadline, numeric = _signals(F.col("_ow"), F.col("_nw"))
    out = base.withColumn("change_type", kind).withColumns({"strengthened": stronger, "weakened": weaker, "binding": binding, "deadline": deadline, "numeric": numeric})
    names = [("strengthened", "obligation_strengthened"), ("weakened", "obligation_weakened"), ("binding", "binding_language_added"), ("deadline", "deadline_language_changed"), ("numeric", "numeric_threshold_changed")]
    both = p.isNotNull() & c.isNotNull()
    found = F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in names]))
    signals = F.when(both, found).when(p.isNull(), F.array(F.lit("new_section"))).otherwise(F.array(F.lit("removed_section")))
    ids = F.when(both, F.array(F.lit("modified"), source_id(p), source_id(c))).otherwise(F.array(kind, F.coalesce(source_id(p), source_id(c))))
    # fixed values: the sentences are part of the result
    said = (
        F.when(p.isNull(), F.concat(F.lit("Section "), c["section_id"], F.lit(" introduces new regulatory text.")))
        .when(c.isNull(), F.concat(F.lit("Section "), p["section_id"], F.lit(" is absent from the current version.")))
        .when(F.col("strengthened"), F.concat(F.lit("The obligation in section "), c["section_id"], F.lit(" has been strengthened.")))
        .when(F.col("weakened"), F.concat(F.lit("The obligation in section "), c["section_id"], F.lit(" has been weakened.")))
        .otherwise(F.concat(F.lit("The regulatory text in section "), c["section_id"], F.lit(" has changed.")))
    )
    silent = F.col("change_type") == "unchanged"
    out = out.withColumns(
        {
            "change_id": change_id(source_id(p), p["version"], source_id(c), c["version"]),
            "signals": signals,
            "claim_id": F.when(~silent, F.concat(F.lit("claim-"), F.substring(F.sha2(F.array_join(ids, "|"), 256), 1, 12))),
            "claim_text": F.when(~silent, said),
        }
    )
    if with_similarity:
        # one pass over the pairs: texts that need no comparison are null there
        apart = both & ~silent
        out = out.withColumns({"_a": F.when(apart, F.col("_old")), "_b": F.when(apart, F.col("_new"))})
        out = out.withColumn("similarity_score", F.when(apart, _ratios("_a", "_b")).when(both, F.lit(1.0)).otherwise(F.lit(0.0))).drop("_a", "_b")
        s = F.col("similarity_score")
        scored = F.lit(0.2) + F.least(F.lit(0.35), (1 - s) * 0.6)
        scored = F.when(F.col("strengthened"), F.greatest(scored, F.lit(0.9))).when(F.col("binding"), F.greatest(scored, F.lit(0.78))).otherwise(scored)
        scored = scored + F.when(F.col("numeric"), 0.18).otherwise(0.0) + F.when(F.col("deadline"), 0.12).otherwise(0.0)
        lone = F.when(F.arrays_overlap(F.coalesce("_ow", "_nw"), F.array(*map(F.lit, REQUIREMENTS))), 0.75).otherwise(0.5)
        title = normalise(p["title"])
        structural = F.when(p["section_id"] == c["section_id"], 0.98).when((title != "") & (title == normalise(c["title"])), 0.94).otherwise(0.72)
        material = F.when(~both, lone).when(silent, 0.0).otherwise(F.round(F.least(scored, F.lit(1.0)), 4))
        sure = F.when(~both, 0.98).when(silent, 1.0).otherwise(F.round(F.least(F.lit(0.99), structural * 0.75 + F.greatest(s, F.lit(0.5)) * 0.25), 4))
        out = out.withColumns({"materiality_score": material, "confidence_score": sure})
        out = out.withColumns({"materiality": _level(F.col("materiality_score"), 0.7, 0.35), "confidence": _level(F.col("confidence_score"), 0.8, 0.55)})
    return out.drop("_old", "_new", "_ow", "_nw", "strengthened", "weakened", "binding", "deadline", "numeric")


def shape_violations(found: DataFrame) -> DataFrame:
    """Changes whose sides do not fit their type."""
    p, c = F.col("previous").isNotNull(), F.col("current").isNotNull()
    right = F.when(F.col("change_type") == "added", c & ~p).when(F.col("change_type") == "removed", p & ~c).otherwise(p & c)
    return found.filter(~right)
