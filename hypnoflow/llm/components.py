"""Connected components of an edge table by alternating large-star and small-star steps, each written to the shared folder
as a table that takes the place of the step before.

Every step is a grouped minimum and a join on the node, so a hub is pre-aggregated and its rows can be split.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_dir


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node (a long) reachable, for every node of edges (a, b)."""
    spark = edges.sparkSession
    folder, steps = posixpath.join(shared_dir(spark), f"components-{uuid.uuid4().hex}"), 0

    def written(step: DataFrame) -> DataFrame:
        nonlocal steps
        steps += 1
        step.write.parquet(f"{folder}/{steps}")
        if steps > 1:
            removed(spark, f"{folder}/{steps - 1}")
        return spark.read.schema(step.schema).parquet(f"{folder}/{steps}")

    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    now = written(edges.where("a != b").select(*ends).distinct())
    state = None
    while True:
        # large star: each node's larger neighbours go to the least of its neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _star(both.where("v > u"), least).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a != b").distinct()
        # small star: each node and its smaller neighbours go to the least of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(down, least).select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = written(small.where("a != b").distinct())
        then, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if then == state:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", F.col("a").alias("r")).distinct())
