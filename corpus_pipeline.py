"""The corpus pipeline: what each stage keeps is what the next one reads.

Defined results, of every stage: texts of any length are judged whole; null text counts as empty; repeated rows and ties are
judged alike; an empty table gives no rows; columns of any further name pass through all stages but the last, which ignores
them. Which rows go is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, packing, shingles, toxicity
from lodestone.llm.common import materialise, table

#: A document whose main language has less than this share of its letters, in scripts of learned languages, is rejected.
MAIN_SHARE = 0.4


def _fresh(docs: DataFrame) -> str:
    """A column name that docs does not have."""
    name = "_other"
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without those of judged(doc_id, keep) that are not kept. A row without a doc_id cannot be named, and stays."""
    name = _fresh(docs)
    rejected = judged.filter(~F.col("keep")).select(F.col("doc_id").alias(name)).distinct()
    # as many as near copies: never broadcast, whatever the size at hand
    return docs.join(rejected.hint("merge"), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels, predicts not to be toxic.

    Null and empty texts are scored like a text without words; without labels of both kinds all documents stay.
    """
    return toxicity.not_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with evidence for one language that has MAIN_SHARE of the letters at least.

    Null and empty texts, and texts without letters, go; so do all if no document has a known language.
    """
    return language.determined(docs, language.train(docs), MAIN_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id; of rows that share it, the one with the smallest text.

    Candidates come from operator 1's search over SimHashes of these shingles and from banded minima; an exact comparison
    decides. Texts without words are one group; rows without a doc_id stay.
    """
    found = materialise(shingles.near_duplicates(docs), "components")
    kept = _without(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("keep")))
    name = _fresh(docs)
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(name))
    repeated = materialise(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col(name)
    first = F.min_by(F.struct(*kept.columns), F.coalesce("text", F.lit(""))).alias(name)
    one = kept.join(repeated, same, "left_semi").groupBy("doc_id").agg(first).select(f"{name}.*")
    return kept.join(repeated, same, "left_anti").unionByName(one)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: every piece with its place. A null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", drop_toxic), ("language", drop_undetermined), ("simhash", drop_near_duplicates), ("packing", pack)]

#: The stages are trained models, fingerprint graphs and bins: not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
