"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixscore.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from every node that has a link.

    Large-star and small-star steps in turn hang every node on the smallest
    neighbour until only stars are left. Each step joins the links with one
    minimum for each node, so no group is ever gathered. The minima are kept as
    a table of their own, which lets Spark split the join where a node has very
    many links. Self-links and repeats do no harm.
    """
    edges = checkpointed(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        low = checkpointed(low)
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = checkpointed(large.distinct())
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where(F.col("u") != F.col("v"))
        edges = checkpointed(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
