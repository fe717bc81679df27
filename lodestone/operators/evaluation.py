"""Evaluation: retrieval, classification and grounding metrics, intervals, splits, dataset rules."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, islice
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.steps import checkpointed


def retrieval_cases(judgments: DataFrame, ranked: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """Per case: recall at k (0 without judgments), reciprocal rank over the whole list, hit at k."""
    if k < 1:
        raise ValueError("k must be positive")
    wanted = judgments.select("case_id", "item").distinct()
    total = wanted.groupBy("case_id").agg(F.count("*").alias("relevant"))
    found = ranked.join(wanted, ["case_id", "item"]).groupBy("case_id").agg(F.min("rank").alias("first"), F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias("at_k"))
    rows = cases.join(total, "case_id", "left").join(found, "case_id", "left")
    recall = F.coalesce(F.try_divide(F.coalesce("at_k", F.lit(0)), F.col("relevant")), F.lit(0.0))
    return rows.select(*cases.columns, recall.alias("recall"), F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("at_k", F.lit(0)) > 0).alias("hit"))


def retrieval_summary(rows: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return rows.agg(F.count("*").alias("cases"), mean("recall").alias("recall_at_k"), mean("reciprocal_rank").alias("mrr"))


def stratum(c):
    low = F.lower(c)
    return F.when(low.isin("easy", "medium", "hard"), low).otherwise("unspecified")


def retrieval_by_stratum(rows: DataFrame, column: str) -> DataFrame:
    """All cases and each stratum in one pass."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    sets = rows.select(F.explode(F.array(F.lit("all"), F.col(column))).alias("stratum"), "recall", "reciprocal_rank")
    return sets.groupBy("stratum").agg(F.count("*").alias("cases"), mean("recall").alias("recall_at_k"), mean("reciprocal_rank").alias("mrr"))


def classification(pairs: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of boolean columns, from unrounded ratios; 0 where a ratio has no base."""
    e, p = F.col(expected), F.col(predicted)
    n = pairs.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * precision * recall, precision + recall)
    return n.select("tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def grounding(reviews: DataFrame) -> DataFrame:
    """Share of claims with a verified citation, and of verified citations."""
    n, yes, no = F.count("*"), F.sum("supported_citations"), F.sum("unsupported_citations")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return reviews.agg(n.alias("claims"), ratio(F.count_if(F.col("supported_citations") > 0), n).alias("groundedness"), ratio(yes, yes + no).alias("citation_accuracy"))


def agreement(pairs: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    right = F.count_if(F.col(expected) == F.col(predicted))
    return pairs.agg(F.count("*").alias("cases"), right.alias("correct"), F.round(F.coalesce(F.try_divide(right, F.count("*")), F.lit(0.0)), 4).alias("accuracy"))


def passed(cases: DataFrame, threshold: float = 0.35) -> DataFrame:
    ok = F.col("expected_material") == (F.col("materiality_score") >= threshold)
    return cases.agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def percentile(values: list[float], p: float) -> float:
    """Linear between the neighbours of (n - 1) p; 0 without values."""
    ordered = sorted(values)
    if not ordered:
        return 0.0
    at = (len(ordered) - 1) * p
    low = int(at)
    high = low + (at > low)
    return ordered[low] * (1 - (at - low)) + ordered[high] * (at - low) if high > low else ordered[low]


#: Buckets into which a round of the selection cuts a range, and values that one task sorts at most.
BUCKETS, SORTED = 1024, 100_000


def percentiles(rows: DataFrame, group: str, value: str, shares: list[float], buckets: int = BUCKETS, at_once: int = SORTED) -> DataFrame:
    """(group, p0, p1, ...): the percentiles of each group, linear between the neighbours of (n - 1) p; nulls do not count.

    Selection in rounds: a group's range is cut into buckets, which are counted; only buckets that hold a wanted rank are cut
    again, until they are of one value or small. No task holds a group's values.
    """
    data = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    whole = checkpointed(data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    positions = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(shares)])
    wanted = whole.select("g", "n", F.explode(positions).alias("s")).withColumn("at", (F.col("n") - 1) * F.col("s.p"))
    wanted = wanted.select("g", F.col("s.k").alias("k"), F.col("at"), F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    # ranges that are still open: from low to high, both included, with the number of values below and in it
    ranges, done = whole.select("g", "low", "high", F.lit(0).cast("long").alias("below"), "n"), []
    ranks = checkpointed(wanted.select("g", "rank").distinct())
    while True:
        holding = checkpointed(ranges.join(ranks, "g").filter((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n"))))
        done.append(holding.filter("low = high").select("g", "rank", F.col("low").alias("v")))
        few = holding.filter((F.col("low") < F.col("high")) & (F.col("n") <= at_once)).select("g", "low", "high", "below").distinct()
        values = data.join(few, "g").filter(F.col("v").between(F.col("low"), F.col("high")))
        placed = values.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("g", "low").orderBy("v")) - 1)
        done.append(placed.join(ranks, ["g", "rank"], "left_semi").select("g", "rank", "v"))
        many = holding.filter((F.col("low") < F.col("high")) & (F.col("n") > at_once)).select("g", "low", "high", "below").distinct()
        if many.isEmpty():
            break
        # halves first, so that the width of a range of any doubles is finite; a range of the least doubles has none, and is cut behind its first value
        width = F.col("high") / 2 - F.col("low") / 2
        part = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor(F.try_divide(F.col("v") / 2 - F.col("low") / 2, width) * buckets))).otherwise((F.col("v") > F.col("low")).cast("long"))
        counted = data.join(many, "g").filter(F.col("v").between(F.col("low"), F.col("high"))).groupBy("g", F.col("low").alias("from"), "below", part.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("g", "from").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = checkpointed(counted.select("g", "low", "high", (F.col("below") + earlier).alias("below"), "n"))
    found = reduce(DataFrame.unionByName, done).distinct()
    ends = wanted.join(found, ["g", "rank"]).groupBy("g", "k", "at").agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    between = F.col("at") - F.floor("at")
    between = F.when(between > 0, F.col("a") * (1 - between) + F.col("b") * between).otherwise(F.col("a"))
    return ends.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("k") == k, between)).alias(f"p{k}") for k in range(len(shares))])


def _draws(n: int, seed: int) -> Iterator[np.ndarray]:
    """What randrange(n) of the standard generator gives, n numbers at a time: its words, shifted, without those that are too large."""
    state = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    left = np.empty(0, np.int64)
    while True:
        while len(left) < n:
            more = (words.random_raw(max(n, 1024)) >> np.uint64(32 - n.bit_length())).astype(np.int64)
            left = np.concatenate([left, more[more < n]])
        yield left[:n]
        left = left[n:]


def bootstrap(values: list[float], statistic: Callable[[list], float], samples: int = 1000, confidence: float = 0.95, seed: int = 20260915) -> tuple[float, float] | None:
    """Percentile interval of the statistic over resamples drawn by the standard generator; None for under two values."""
    if samples < 1:
        raise ValueError("samples must be positive")
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    n = len(values)
    if n < 2:
        return None
    array = np.array(values)
    resamples = (array[at].tolist() if array.dtype.kind in "biuf" else [values[i] for i in at] for at in islice(_draws(n, seed), samples))
    found = [statistic(v) for v in resamples]
    tail = (1 - confidence) / 2
    return round(percentile(found, tail), 4), round(percentile(found, 1 - tail), 4)


def bootstrap_means(rows: DataFrame, group: str, order: str, value: str, samples: int = 1000, seed: int = 20260915) -> DataFrame:
    """Interval of the mean for each group of cases (a benchmark's cases, a small table), bit for bit repeatable."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        values = g.sort_values(order)[value].tolist()
        found = bootstrap(values, lambda v: round(sum(v) / len(v), 4), samples, seed=seed)
        low, high = found or (None, None)
        return pd.DataFrame({group: [g[group].iloc[0]], "cases": [len(values)], "lower": [low], "upper": [high]})

    return rows.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} string, cases long, lower double, upper double")


#: Chances that a row stands in a resample at most 0, 1, 2, ... times; the last one is 1 in double precision.
POISSON = list(accumulate(exp(-1) / factorial(k) for k in range(18)))


def poisson_bootstrap(rows: DataFrame, group: str, key: str, value: str, samples: int = 1000) -> DataFrame:
    """Interval of the mean for groups of any size: each row stands in each resample as often as a hash says (Poisson of 1)."""
    u = F.pmod(F.xxhash64(key, "replicate"), F.lit(1 << 53)) / float(1 << 53)
    times = F.when(u < POISSON[0], 0)
    for k, s in enumerate(POISSON[1:], 1):
        times = times.when(u < s, k)
    times = times.otherwise(len(POISSON))
    dealt = rows.select(group, key, value, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("replicate")).withColumn("times", times)
    means = dealt.groupBy(group, "replicate").agg(F.try_divide(F.sum(F.col("times") * F.col(value)), F.sum("times")).alias("mean"))
    found = percentiles(checkpointed(means), group, "mean", [0.025, 0.975])  # a row a replicate; resamples are drawn once
    return found.select(group, F.round("p0", 4).alias("lower"), F.round("p1", 4).alias("upper"))


def select_split(cases: DataFrame, split: str, manifest: DataFrame | None = None, default: str = "test") -> DataFrame:
    """cases(id, split): an own split decides; else the manifest's ids; else only the default split takes them."""
    if split == "all":
        return cases
    own = cases.filter(F.col("split") == split)
    free = cases.filter(F.col("split").isNull())
    if manifest is not None:
        free = free.join(manifest.select(F.col("id").cast("string").alias("_id")), F.col("id").cast("string") == F.col("_id"), "left_semi")
    elif split != default:
        free = free.limit(0)
    return own.unionByName(free)


def family_leaks(items: DataFrame) -> DataFrame:
    return items.groupBy("family_id").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def duplicate_ids(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def missing_references(citations: DataFrame, sections: DataFrame) -> DataFrame:
    return citations.join(sections, ["document_id", "section_id"], "left_anti")
