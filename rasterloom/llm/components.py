"""Connected components of a link table by alternating star steps: a distributed union-find in DataFrame operations.

Each round hooks every node to the smallest node it knows (large star), then flattens what points upwards (small
star). The smallest neighbour comes from an aggregation (combined before the shuffle) joined back, so that a node with
very many links is never gathered in one task. Rounds are written to the shared folder; nothing reaches the driver but
a count and a checksum that tell when the links stop changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, upward: bool) -> DataFrame:
    """One star step over links (u, v). upward: large star; else small star."""
    if upward:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("c"))
    if upward:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable. Ids are longs.

    Links to oneself and repeated links are ignored; rows with a null end are dropped; no links give no rows.
    """
    spark = links.sparkSession
    now = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, path = None, None
    while True:
        now.write.parquet(fresh := common.scratch_path(spark, "links"))
        now = spark.read.schema("u long, v long").parquet(fresh)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if path:
            common.remove(spark, path)
        path = fresh
        if not state["n"] or (state["n"], state["s"]) == before:
            break
        before = state["n"], state["s"]
        now = _star(_star(now, True), False)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
