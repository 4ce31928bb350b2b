"""Connected components of an edge table, by contraction: each round hooks every root to its smallest neighbour,
shortens the paths and keeps only edges between different roots.  Roots at least halve where edges are left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has u and v; result: node and label (its component's smallest node) for all nodes that have an edge."""
    e = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges", True)
    labels = stored(e.select(F.col("u").alias("node")).union(e.select("v")).distinct().withColumn("label", F.col("node")), "labels", True)
    while e.limit(1).count():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("root"), F.least("u", "m").alias("parent"))
        up = stored(up, "parents", True)
        for _ in range(2):  # parent of the parent, twice
            further = up.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))
            up = up.join(further, "parent").select("root", F.col("grand").alias("parent"))
        up = stored(up, "parents", True)
        labels = stored(
            labels.join(up.withColumnRenamed("root", "label"), "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels", True
        )
        u = up.select(F.col("root").alias("u"), F.col("parent").alias("pu"))
        v = up.select(F.col("root").alias("v"), F.col("parent").alias("pv"))
        e = stored(e.join(u, "u").join(v, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges", True)
    return labels
