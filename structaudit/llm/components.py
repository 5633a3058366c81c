"""Connected components by alternating stars, for edges of any number and any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structaudit.llm.common import checkpointed


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node's larger (or not larger) neighbours move to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round is written to the checkpoint folder. Rounds end when a round changes nothing; their
    number grows with the logarithm of the longest path.
    """
    now = checkpointed(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark["n"] == 0 or (mark["n"], mark["h"]) == before:
            break
        before = (mark["n"], mark["h"])
        now = checkpointed(_stars(_stars(now, large=True), large=False))
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
