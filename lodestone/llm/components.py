"""Connected components of an edge table by alternating large and small stars; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise


def _star(edges: DataFrame) -> DataFrame:
    """edges(a > b): one large-star step, then one small-star step."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a > b")
    centre = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(centre, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(centre.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of long ids -> (id, root): for every linked id but the roots, the smallest id that it reaches."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = materialise(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = tuple(state)
        edges = materialise(_star(edges), "edges")
