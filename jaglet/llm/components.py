"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jaglet.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the smallest node that links reach.

    Self-links and repeated links are allowed, nulls are dropped; an empty table gives an empty table. Each
    round rewrites the edges in the shared folder, so no lineage grows and nothing goes to the driver but one
    count and one checksum; rounds go on until these settle, about as many as the logarithm of the nodes. Minimum labels are aggregated map-side; joins are plain equi-joins, which adaptive
    execution splits where a hub is hot.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = materialize(now, "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not seen[0] or tuple(seen) == before:
            break
        before = tuple(seen)
        now = materialize(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
