"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outbreak_spark.llm.common import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """v, c for each vertex with an edge a - b: c is the least vertex that it reaches.

    Each step rewires every vertex's neighbours to the least of them; the rows are edges, at most one per pair, so no
    neighbourhood is gathered in one place. Each result is written, which cuts lineage.
    """
    now = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    sign, k = None, 0
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        k += 1
        now = work.write(small, f"{name}{k}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}{k - 2}") if k > 1 else None
        if new == sign:
            break
        sign = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select(F.col("v"), F.col("v").alias("c")).distinct())
