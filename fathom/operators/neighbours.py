"""Nearest neighbours by cosine: exact search for stated queries, in blocks, over all rows or over the lists they probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_bytes: int = 16 << 20) -> DataFrame:
    """id, other, sim, rank: each query's k nearest rows but itself, ties to the smaller key; a zero vector has cosine 0.

    Queries go to the executors in blocks of bounded size; a task keeps the k best rows of each query so far and hands them
    on once. All vectors have one length.
    """
    return search(vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")), queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("q")), k, block_bytes)


def search(rows: DataFrame, asked: DataFrame, k: int, block_bytes: int = 16 << 20) -> DataFrame:
    """rows: key, v and, where only some lists are searched, list; asked: id, q and the lists."""
    blocks = max(1, -(-(asked.agg(F.sum(F.size("q") * 8)).first()[0] or 0) // block_bytes))
    sc, found = rows.sparkSession.sparkContext, None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        lists = np.array([r.lists for r in part], np.int32) if "lists" in asked.columns else None  # as many for each query
        sent = sc.broadcast((np.array([r.id for r in part], np.int64), unit(np.array([r.q for r in part], float)) if part else np.zeros((0, 1)), lists))
        read = rows if lists is None else rows.where(F.col("list").isin(np.unique(lists).tolist()))  # other lists are not read

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, lists = sent.value
            best = Best(ids, k)
            of_list = {} if lists is None else {x: np.flatnonzero((lists == x).any(axis=1)) for x in np.unique(lists).tolist()}
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                keys, v = batch["key"].to_numpy(zero_copy_only=False), unit(matrix(batch["v"]))
                if lists is None:
                    best.add(None, keys, q, v)
                    continue
                of = batch["list"].to_numpy(zero_copy_only=False)
                for x in np.unique(of).tolist():
                    if x in of_list:
                        best.add(of_list[x], keys[of == x], q, v[of == x])
            yield best.rows()

        one = read.mapInArrow(run, "id long, other long, sim double")
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("id").orderBy(F.desc(F.round("sim", 9)), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best rows of each query so far. Rows that may be among them wait, and are merged when they outnumber those held."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.key, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def add(self, which: np.ndarray | None, keys: np.ndarray, q: np.ndarray, v: np.ndarray, most: int = 1 << 19) -> None:
        """Rows (keys, v) for those queries (None: all); a slice of rows at a time, so that the products stay small."""
        q = q if which is None else q[which]
        step = max(1, most // len(q))
        for a in range(0, len(keys), step):
            sim = q @ v[a : a + step].T
            least = self.least if which is None else self.least[which]
            i, j = np.nonzero(sim >= (least - 1e-9)[:, None])  # rounding moves none further
            sim, key, query = sim[i, j], keys[a : a + step][j], i if which is None else which[i]
            near = (np.round(sim, 9) >= self.least[query]) & (self.ids[query] != key)
            self.waiting.append((query[near], key[near], sim[near]))
            self.many += len(self.waiting[-1][0])
            if self.many > max(most // 4, len(self.query)):
                self.merge()

    def merge(self) -> None:
        query, key, sim = (np.concatenate(x) for x in zip((self.query, self.key, self.sim), *self.waiting, strict=True))
        self.waiting, self.many = [], 0
        order = np.lexsort((key, -np.round(sim, 9), query))
        query, key, sim = query[order], key[order], sim[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[query[rank == self.k - 1]] = np.round(sim[rank == self.k - 1], 9)
        self.query, self.key, self.sim = (x[rank < self.k] for x in (query, key, sim))

    def rows(self) -> pa.RecordBatch:
        self.merge()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.key), pa.array(self.sim)], names=["id", "other", "sim"])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)
