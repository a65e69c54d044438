"""Transitive closure of chains of links by spreading labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root (the least node reached) for edges (a, b). Labels double their reach each round; ends when none moves."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        near = both.join(label, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "root").unionByName(label).groupBy("node").agg(F.min("root").alias("root"))
        far = near.join(near.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", F.col("top").alias("root"))
        far = far.persist()  # a round is read three times; lost parts are computed again
        moved = far.join(label.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty()
        label = far
        if moved:
            break
    return label
