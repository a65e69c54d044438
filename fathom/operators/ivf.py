"""An inverted-file index of vectors: k-means centroids, rows in lists by their nearest centroid, searches that probe some lists.

k-means starts from stated rows (those with the least md5 of their key), so the same table always gives the same clusters;
Spark's own estimator draws its start itself and so can't be compared row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neighbours import matrix, search, unit

SAMPLE = 200_000


def kmeans(vectors: DataFrame, k: int, rounds: int, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """k centroids of unit length, by cosine. Fitted on about `sample` rows, chosen by a hash of the key, if there are more.

    Each round is one pass: tasks sum up their rows for each centroid, Spark adds the sums. A centroid without rows stays.
    """
    rows = _rows(vectors, key, vector)
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * (sample / n)))
    first = rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(k).collect()
    if not first:
        return np.zeros((0, 0))
    centroids = unit(np.array([r.v for r in first], float))
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(sent.value)
            for batch in batches:
                if batch.num_rows:
                    v = unit(matrix(batch["v"]))
                    np.add.at(sums, closest(v, sent.value, 1)[:, 0], v)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(list(sums), pa.list_(pa.float64()))], names=["list", "s"])

        parts = rows.mapInArrow(run, "list long, s array<double>").select("list", F.posexplode("s").alias("pos", "x"))
        new = np.zeros_like(centroids)
        for r in parts.groupBy("list", "pos").agg(F.sum("x").alias("x")).collect():  # k rows for each dimension
            new[r.list, r.pos] = r.x
        centroids = np.where(np.abs(new).sum(axis=1, keepdims=True) > 0, unit(new), centroids)
    return centroids


def closest(v: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n closest centroids of each row, ties to the smaller number."""
    sim = np.round(v @ centroids.T, 9)
    return np.lexsort((np.broadcast_to(np.arange(sim.shape[1]), sim.shape), -sim))[:, :n]


def _rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


def assigned(vectors: DataFrame, centroids: np.ndarray, n: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, v, lists: the n closest centroids of each row, the closest first."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = closest(unit(matrix(batch["v"])), sent.value, n)
                yield pa.RecordBatch.from_arrays([batch["key"], batch["v"], pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["key", "v", "lists"])

    return _rows(vectors, key, vector).mapInArrow(run, "key long, v array<double>, lists array<int>")


def build(vectors: DataFrame, centroids: np.ndarray, path: str, spread: int = 8, **columns: str) -> None:
    """Writes the index below path (rows without a vector are left out): lists as partitions of a table (each from up to `spread` tasks, so a list with most of
    the rows is no single task's), and the centroids. Every row is indexed."""
    spark = vectors.sparkSession
    rows = assigned(vectors, centroids, **columns).select("key", "v", F.col("lists")[0].alias("list"))
    rows.repartition("list", F.pmod(F.xxhash64("key"), F.lit(spread))).write.partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, c array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def centroids_of(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.c for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])


def probe(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None, **columns: str) -> DataFrame:
    """id, other, sim, rank as nearest() has them, from the `probes` lists closest to each query; None: all lists, which is
    the exact search. Only lists that a block of queries probes are read."""
    centroids = centroids_of(spark, path)
    asked = assigned(queries, centroids, probes or len(centroids), **columns).select(F.col("key").alias("id"), F.col("v").alias("q"), "lists")
    rows = spark.read.schema("key long, v array<double>, list int").parquet(f"{path}/lists")
    return search(rows, asked if probes else asked.drop("lists"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, recall: how many of the exact neighbours were found."""
    pairs = exact.select("id", "other").join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
