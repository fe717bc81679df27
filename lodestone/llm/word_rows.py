"""Per-word feature rows for numpy models: each distinct word is computed once a worker, then looked up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

#: Characters of the texts that a model is fitted on, at most (about), and of the longest one of them.
SAMPLE_CHARS, LONGEST = 64_000_000, 1_000_000
#: Words that a worker keeps; beyond that the cache starts anew, so memory stays bounded.
CACHE_WORDS = 300_000


class WordRows:
    """word -> row of a float matrix; compute gets the list of missing words. Row 0 is zeros: no word."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int = CACHE_WORDS):
        self.compute, self.width, self.limit = compute, width, limit
        self._reset(1024)

    def _reset(self, size: int):
        self.places: dict[str, int] = {}
        self.rows = np.zeros((size, self.width), np.float32)

    def __call__(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Row numbers of each list's words; rows holds the rows until the next call."""
        need = set().union(*lists)
        missing = list(need.difference(self.places))
        if missing and len(self.places) + len(missing) > self.limit:
            self._reset(1024)
            missing = list(need)
        if missing:
            at = len(self.places) + 1
            if at + len(missing) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), at + len(missing)), self.width), np.float32)
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at : at + len(missing)] = self.compute(missing)
            self.places.update(zip(missing, range(at, at + len(missing))))
        place = self.places.__getitem__
        return [np.fromiter(map(place, words), np.int64, len(words)) for words in lists]


def bounded_sample(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """About size rows (all, if there are fewer), chosen by a hash of key: the same rows on every run."""
    n = rows.select(key).count()
    if n <= size:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_003)) < int(1_000_003 * size / n))


def bounded_texts(rows: DataFrame, size: int = SAMPLE_CHARS, longest: int = LONGEST) -> list:
    """rows(doc_id, text, ...) for fitting a model, sorted: one row for each doc_id (the smallest), about size characters in all, on the driver."""
    rows = materialise(rows.filter(F.length("text") <= longest), "sample")
    chars, repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("chars")).agg(F.sum("chars"), F.max("n") > 1).first()
    if chars and chars > size:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("chars"), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * size / chars))
    if repeated:
        rest = [c for c in rows.columns if c not in ("doc_id", "text")]
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("r")).select("doc_id", "r.*")
    return sorted(rows.collect(), key=lambda r: r["doc_id"])
