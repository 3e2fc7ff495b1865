"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panewise.llm.tables import discard, staged


def roots(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` of every node but the smallest of its component, from ``a``, ``b``.

    Each round hangs the neighbours of a node below the smallest of them; rounds grow with
    the logarithm of the longest path. A round is written to the shared folder, and the one
    before it deleted. Neighbours are never gathered: the smallest comes from a combined aggregate, and the join that follows, of
    two tables, can be split where a node has many.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")
    )
    pairs, before = staged(pairs.distinct(), "components"), None
    while True:
        size = pairs.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            return pairs
        before = size
        both = pairs.unionByName(pairs.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = staged(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least")), "components")
        large = (
            both.join(least, "node")
            .where(F.col("root") > F.col("node"))
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
            .where(F.col("node") != F.col("root"))
            .distinct()
        )
        large = staged(large, "components")
        lower = staged(large.groupBy("node").agg(F.min("root").alias("least")), "components")
        small = large.join(lower, "node")
        hung = small.select(F.col("root").alias("node"), F.col("least").alias("root")).where(
            F.col("node") != F.col("root")
        )
        own = lower.select("node", F.col("least").alias("root"))
        old, pairs = pairs, staged(hung.unionByName(own).distinct(), "components")
        discard(old, least, large, lower)
