"""Document quality by weak supervision, in DataFrame functions only.

Rules over the counts of a document vote good (1), bad (-1) or abstain (0). Documents with the same votes are one row of a
table of at most 3**rules rows, on which expectation-maximisation estimates, for each rule, how often it is right about
good and about bad documents, and the share of good ones. The posterior probability of being good replaces a filter that
every rule must pass. Nothing here shuffles text: the repeated windows of a text are found by sorting their hashes (64
bits) inside the row.

Defined results: words are split at ASCII white space; null text has none; a text without words fails the base rules;
repeated rows are judged alike; an empty table gives no rows; texts of any length are counted whole; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

BLANK = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rounds of expectation-maximisation; with WEIGHT and the bounds below, parameters move by less than 0.001 in the last ones.
ROUNDS = 15
#: Between which the share of good documents is held: labels that are all alike would otherwise run to 0 or 1.
LEAST_SHARE, MOST_SHARE = 0.5, 0.98
#: Where expectation-maximisation starts, and the weight in documents of that start: P(good vote | good), P(bad vote | bad), P(good).
START_GOOD, START_BAD, START_SHARE, WEIGHT = 0.98, 0.5, 0.85, 20.0
KEEP = 0.5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the further counts that rules look at."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.filter(F.split(text, BLANK), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.char_length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_shouts"),
        F.char_length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    words = F.col("words")
    windows = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    second = first.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_shouts",
        "n_upper",
        F.size(F.filter("words", lambda w: w.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_marked"),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.slice(windows, 1, F.greatest(F.size("words") - 2, F.lit(0)))).alias("windows"),
    )
    ranked = F.col("windows")
    twice = F.filter(ranked, lambda x, k: F.coalesce(x["h"] == F.get(ranked, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ranked, k + 1)["h"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))["n"]
    return second.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines", "n_shouts", "n_upper", "n_marked")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def rules() -> dict[str, Column]:
    n = F.col("n_words")
    per_word = lambda c: F.try_divide(F.col(c), n)
    mean, dup = per_word("word_chars"), F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))
    return {
        "v_length": _vote(n < 30, n >= 60),
        "v_word_length": _vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        "v_symbols": _vote(per_word("n_symbols") > 0.3, per_word("n_symbols") < 0.1),
        "v_marked": _vote(per_word("n_marked") > 0.3, per_word("n_marked") < 0.1),
        "v_upper": _vote(per_word("n_upper") > 2, per_word("n_upper") < 0.5),
        "v_shouts": _vote(per_word("n_shouts") > 0.5, per_word("n_shouts") < 0.05),
        "v_dup_lines": _vote(dup > 0.5, (F.col("n_lines") >= 2) & (dup < 0.05)),
        "v_repeats": _vote(per_word("n_repeat_words") > 0.4, per_word("n_repeat_words") < 0.1),
    }


def _likelihood(names: list[str], p: dict[str, float], good: bool) -> Column:
    """log P(votes | class) + log P(class)."""
    share = p["share"] if good else 1 - p["share"]
    out = F.log(F.lit(share))
    for v in names:
        yes = p[f"good_{v}"] if good else 1 - p[f"bad_{v}"]
        out = out + F.when(F.col(v) == 1, F.log(F.lit(yes))).when(F.col(v) == -1, F.log(F.lit(1 - yes))).otherwise(F.lit(0.0))
    return out


def posterior(names: list[str], p: dict[str, float]) -> Column:
    return 1 / (1 + F.exp(_likelihood(names, p, False) - _likelihood(names, p, True)))


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation over the table of vote patterns; each round is one aggregate with literal parameters."""
    patterns = materialise(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes")
    p = {"share": START_SHARE} | {f"good_{v}": START_GOOD for v in names} | {f"bad_{v}": START_BAD for v in names}
    for _ in range(rounds):
        e = patterns.select(*names, F.col("n").cast("double").alias("n"), posterior(names, p).alias("g"))
        good, bad = F.col("n") * F.col("g"), F.col("n") * (1 - F.col("g"))
        sums = [F.sum(good).alias("good"), F.sum("n").alias("n")]
        for v in names:
            voted, right = F.when(F.col(v) != 0, 1.0).otherwise(0.0), F.when(F.col(v) == 1, 1.0).otherwise(0.0)
            sums += [F.sum(good * voted).alias(f"gv_{v}"), F.sum(good * right).alias(f"gr_{v}"), F.sum(bad * voted).alias(f"bv_{v}"), F.sum(bad * (voted - right)).alias(f"br_{v}")]
        s = e.agg(*sums).first()
        if not s["n"]:
            break
        bound = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        new = {"share": min(max((s["good"] + WEIGHT * START_SHARE) / (s["n"] + WEIGHT), LEAST_SHARE), MOST_SHARE)}
        for v in names:
            new[f"good_{v}"] = bound((s[f"gr_{v}"] + WEIGHT * START_GOOD) / (s[f"gv_{v}"] + WEIGHT))
            new[f"bad_{v}"] = bound((s[f"br_{v}"] + WEIGHT * START_BAD) / (s[f"bv_{v}"] + WEIGHT))
        p = new
    return p


def judge(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, base counts, base_failed, kept, quality (posterior), and the votes."""
    named = rules()
    names = list(named)
    rows = materialise(measured(docs).select("*", *(c.cast("int").alias(v) for v, c in named.items())), "measured")
    p = estimate(rows, names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = rows.select("doc_id", *BASE, failed.alias("base_failed"), posterior(names, p).alias("quality"), *names)
    return scored.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("quality") >= KEEP)).alias("kept"), "quality", *names)
