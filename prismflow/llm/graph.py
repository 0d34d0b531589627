"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow.llm import common


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b), in alternating large-star and small-star rounds.

    A round only moves links to smaller nodes, and the number of rounds grows with the logarithm of a
    component's length. Each round aggregates before it shuffles and is checkpointed; the driver only gets a count.
    """
    links = common.checkpoint(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        # Large star: each node links its larger neighbours to its smallest neighbour (or itself).
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        star = small.select("m", F.col("v").alias("x")).unionByName(least.select("m", F.col("u").alias("x"))).where("m <> x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        links = common.checkpoint(star)
        n, total = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
