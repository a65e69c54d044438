"""Exact top-k search by inner product, pruned by segment statistics at several resolutions.

A vector is cut into equal segments; a segment keeps its mean and deviation. For segments of length L,
<a, b> <= sum over segments of L * (mean_a * mean_b + dev_a * dev_b) (Cauchy and Schwarz on the centred parts), an upper
bound of the score and so a lower bound of the distance |a|^2 + |b|^2 - 2 <a, b>. Candidates whose bound is below the
query's k-th best score so far are dropped at the coarse level, then at finer ones; survivors are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = "query_key long, query_id long, vec_id long, score long"
OUT_ARROW = pa.schema([(x, pa.int64()) for x in ("query_key", "query_id", "vec_id", "score")])
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vector: Column, scale: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def features(rows: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(L) * mean and sqrt(L) * deviation, so that a plain inner product of two gives the bound."""
    edges = np.linspace(0, rows.shape[1], segments + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            root = np.sqrt(b - a)
            out += [rows[:, a:b].mean(axis=1) * root, rows[:, a:b].std(axis=1) * root]
    return np.stack(out, axis=1) if out else np.zeros((len(rows), 1))


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All queries by all rows, exact: in floats where these hold all sums, else in Python's integers (kept to 64 bits)."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if most < 2**24:
        return queries.astype(np.float32) @ rows.astype(np.float32).T
    if most < EXACT:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    low, high = -(2**63), 2**63 - 1
    return np.clip(queries.astype(object) @ rows.astype(object).T, low, high).astype(np.int64)


class Searcher:
    """Top-k of one block of queries of one dimension over candidates that come in pieces.

    A level that keeps over a quarter of the pairs is tried only now and then: its bound cannot tell these vectors apart.
    """

    def __init__(self, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, levels: tuple[int, ...], tile: int = 512):
        self.keys, self.ids, self.queries, self.k, self.tile = keys, ids, queries, k, tile
        self.levels = [x for x in levels if x < queries.shape[1]]
        self.feats = [features(queries.astype(np.float64), x).astype(np.float32) for x in self.levels]
        self.floor = np.full(len(keys), -np.inf)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(keys)
        self.idle = [0] * len(self.levels)

    def seed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """The k-th best score over some of the candidates, as a first floor; they are offered again later."""
        for at in range(0, len(self.keys), self.tile):
            part = slice(at, at + self.tile)
            score = exact_scores(self.queries[part], rows).astype(np.float64)
            score[self.ids[part, None] == ids[None, :]] = -np.inf
            if score.shape[1] >= self.k:
                self.floor[part] = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]

    def offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for a in range(0, len(ids), 4096):
            self._offer(ids[a : a + 4096], rows[a : a + 4096])

    def _offer(self, ids: np.ndarray, rows: np.ndarray) -> None:
        feats: dict[int, np.ndarray] = {}
        for at in range(0, len(self.keys), self.tile):
            part = slice(at, at + self.tile)
            floor = self.floor[part, None]
            pairs = None
            for n, segments in enumerate(self.levels):
                if self.idle[n]:
                    self.idle[n] -= 1
                    continue
                if n not in feats:
                    feats[n] = features(rows.astype(np.float64), segments).astype(np.float32)
                own, other = self.feats[n][part], feats[n]
                slack = 1e-4 * (1 + float(np.linalg.norm(own, axis=1).max()) * float(np.linalg.norm(other, axis=1).max()))
                if pairs is None:
                    keep = own @ other.T + np.float32(slack) >= floor
                    share = keep.mean()
                    if share <= 0.25:
                        pairs = np.nonzero(keep)
                else:
                    q, c = pairs
                    keep = np.einsum("ij,ij->i", own[q], other[c]) + slack >= floor[q, 0]
                    share, pairs = keep.mean() if len(q) else 0.0, (q[keep], c[keep])
                if share > 0.25:
                    self.idle[n] = 64
            if pairs is None:
                score = exact_scores(self.queries[part], rows)
                q, c = np.nonzero(score >= floor)
                score = score[q, c]
            else:
                q, c = pairs
                score = np.concatenate([np.zeros(0), *(exact_scores(self.queries[part][n : n + 1], rows[c[q == n]])[0] for n in np.unique(q))])
                keep = score >= floor[q, 0]
                q, c, score = q[keep], c[keep], score[keep]
            other = self.ids[part][q] != ids[c]
            if other.any():
                self._merge(at, q[other], ids[c[other]], score[other].astype(np.int64))

    def _merge(self, at: int, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, np.negative(score, where=score != -(2**63), out=np.full(len(score), 2**63 - 1)), q))
        q, ids, score = q[order], ids[order], score[order]
        edges = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = at + q[a]
            b = min(b, a + self.k)
            old_ids, old = self.best[n]
            new_ids, new = np.r_[old_ids, ids[a:b]], np.r_[old, score[a:b]]
            rank = np.lexsort((new_ids, -np.maximum(new, -(2**63) + 1)))[: self.k]
            self.best[n] = new_ids[rank], new[rank]
            if len(rank) == self.k:
                self.floor[n] = max(self.floor[n], float(np.nextafter(float(new[rank[-1]]), -np.inf)) if abs(int(new[rank[-1]])) >= EXACT else float(new[rank[-1]]))

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for key, own, (ids, score) in zip(self.keys, self.ids, self.best, strict=True):
            if len(ids):
                yield key, own, ids, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, levels: tuple[int, ...] = (4, 16), block_bytes: int = 16 << 20, seeds: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products over all rows but its own.

    vectors, queries: vec_id, q (array of long). Ties go to the smaller vec_id. Rows with a null vec_id or null q take no
    part; rows with the query's vec_id count as its own; a repeated query row gets a result of its own; vectors of
    another length than the query's take no part in its search. Queries are a stated set and are sent to the executors
    in blocks of about block_bytes, one pass over all vectors for each block. With each go `seeds` candidates, whose k-th best
    score is a first floor for the pruning; all candidates are searched in any case.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "q").where(F.col("vec_id").isNotNull() & F.col("q").isNotNull())
    asked = queries.select("vec_id", "q").where(F.col("vec_id").isNotNull() & F.col("q").isNotNull())
    n_bytes = asked.agg(F.sum(F.size("q") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    found = spark.createDataFrame([], OUT)
    some = rows.limit(seeds).toArrow()
    some = some["vec_id"].to_numpy(), [np.asarray(x, np.int64) for x in some["q"].to_pylist()]
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        own = part.toArrow()
        sent = spark.sparkContext.broadcast((own["vec_id"].to_numpy(), [np.asarray(x, np.int64) for x in own["q"].to_pylist()]))
        found = found.unionByName(rows.mapInArrow(_search(sent, some, b << 40, k, levels), OUT))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(sent, some, first_key: int, k: int, levels: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        lengths = np.array([len(x) for x in vectors], np.int64)
        searchers = {}
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            searchers[int(d)] = Searcher(first_key + at, ids[at], np.stack([vectors[i] for i in at]), k, levels)
        for d, s in searchers.items():
            at = [i for i, x in enumerate(some[1]) if len(x) == d]
            if at:
                s.seed(some[0][at], np.stack([some[1][i] for i in at]))
        for batch in batches:
            got, values = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("q")
            flat, size = values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy())
            starts = np.r_[0, np.cumsum(size)]
            for d in np.unique(size):
                if int(d) in searchers:
                    at = np.flatnonzero(size == d)
                    searchers[int(d)].offer(got[at], flat[(starts[at][:, None] + np.arange(d)[None, :])])
        for s in searchers.values():
            for key, own, found, score in s.rows():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x)) if np.isscalar(x) else pa.array(x) for x in (int(key), int(own), found, score)], schema=OUT_ARROW)

    return run
