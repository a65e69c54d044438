"""Benchmark decontamination with suffix arrays over the training documents.

The documents are cut into shards that fit in memory. A shard's words become numbers (words that no test item has: 0)
and the suffixes that can hold a whole window are sorted: the shard's suffix array. Every test suffix is binary-searched
in every shard; the range that it opens gives all verbatim occurrences with their locations. Occurrences one word further
in both texts are joined to the longest verbatim matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, written

#: A-Z to a-z; digits, letters and all bytes of non-ASCII characters stay; the rest separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20  # of test items, about 100 MB in the driver and in each worker
MATCH = "doc_id long, doc_start long, n_words long, item_id string, item_start long"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class TestSuffixes:
    """The windows of one block of test items, ready for searching: each item's suffixes cut at `window` words.

    low: the sorted distinct windows as keys; a window's places are edges[k]:edges[k + 1] of item and start.
    """

    __test__ = False  # not a test class

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [x for x, _ in items]
        get = self.vocabulary.setdefault
        texts = [np.array([get(w, len(self.vocabulary) + 1) for w in words(text)], np.int32) for _, text in items]
        sizes = np.array([len(x) for x in texts], np.int64)
        count = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        lengths = np.minimum(sizes, window)[item]
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = 62 // self.bits
        self.shortest, self.longest = (int(lengths.min()), int(lengths.max())) if len(item) else (1, 1)
        flat = np.concatenate([*texts, np.zeros(window, np.int32)])
        rows = np.lib.stride_tricks.sliding_window_view(flat, self.longest)[(np.cumsum(sizes) - sizes)[item] + start]
        low = self.keys(np.where(np.arange(self.longest) < lengths[:, None], rows, 0))
        order = np.lexsort(low[::-1]) if len(item) else np.zeros(0, np.int64)
        new = np.zeros(len(order), bool)
        for key in low:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        new[:1] = True
        heads = np.flatnonzero(new)
        self.low, self.lengths = [key[order[heads]] for key in low], lengths[order[heads]]
        self.item, self.start, self.edges = item[order].astype(np.int32), start[order].astype(np.int32), np.r_[heads, len(order)]

    @cached_property
    def high(self) -> list[np.ndarray]:
        """As low, with the greatest word in the places behind shorter windows."""
        full = np.where(np.arange(self.longest) < self.lengths[:, None], 0, (1 << self.bits) - 1)
        return [a | b for a, b in zip(self.low, self.keys(full), strict=True)]

    def names_of(self, windows: np.ndarray) -> list[str]:
        """The items that hold any of some windows."""
        found = {int(i) for w in np.unique(windows) for i in np.unique(self.item[self.edges[w] : self.edges[w + 1]])}
        return sorted({self.names[i] for i in found})

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """Each row's words packed into a few integers that compare as the words do."""
        out = []
        for a in range(0, rows.shape[1], self.per_key):
            key = np.zeros(len(rows), np.int64)
            for b in range(a, a + self.per_key):
                key = key << self.bits | (rows[:, b].astype(np.int64) if b < rows.shape[1] else 0)
            out.append(key)
        return out


class Shard:
    """The suffix array over the words of some documents. first: where each document's words begin."""

    def __init__(self, ids: np.ndarray, tests: TestSuffixes):
        n, depth = len(ids), tests.longest
        place = np.arange(n)
        end = np.minimum.accumulate(np.where(ids == 0, place, n)[::-1])[::-1]  # of the run of test words that a position lies in
        start = np.flatnonzero(end - place >= tests.shortest)
        padded = np.r_[ids, np.zeros(depth, ids.dtype)]
        rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[start] if len(start) else np.zeros((0, depth), np.int64)
        keys = tests.keys(rows.astype(np.int64))
        order = np.lexsort(keys[::-1])
        self.suffixes, self.keys, self.tests = start[order], [k[order] for k in keys], tests

    def _bound(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all wanted keys at once; after: behind those that are equal."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(self.suffixes))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, len(self.suffixes) - 1)
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for own, other in zip(self.keys, wanted, strict=True):
                less |= equal & (own[at] < other)
                equal &= own[at] == other
            up = open_ & (less | (equal & after))
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return lo

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence of every test window in the shard."""
        if not len(self.suffixes) or not len(self.tests.lengths):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self._bound(self.tests.low, False), self._bound(self.tests.high, True)
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        return window, self.suffixes[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def search(texts: list[bytes | None], tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text; document, window and place (word) of each occurrence."""
    get, ids, size = tests.vocabulary.get, [], []
    for text in texts:
        w = words(text)
        size.append(len(w))
        ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        ids.append(np.zeros(1, np.int32))  # nothing matches over the end of a document
    n = np.array(size, np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    window, at = Shard(np.concatenate(ids) if ids else np.zeros(0, np.int32), tests).occurrences()
    doc = np.searchsorted(first, at, "right") - 1
    return n, doc, window, at - first[doc]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> int:
    """Words inside any of the spans."""
    if not len(starts):
        return 0
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def judged(texts: list[bytes | None], tests: TestSuffixes) -> list[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Per text: its number of words, the spans of its occurrences (start, length) and the items that occur."""
    n, doc, window, at = search(texts, tests)
    order = np.argsort(doc, kind="stable")
    doc, window, at = doc[order], window[order], at[order]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, size in enumerate(n):
        if edges[k] == edges[k + 1]:
            out.append((int(size), at[:0], at[:0], []))
            continue
        part = slice(edges[k], edges[k + 1])
        out.append((int(size), at[part], tests.lengths[window[part]], tests.names_of(window[part])))
    return out


def maximal(doc: np.ndarray, window: np.ndarray, at: np.ndarray, tests: TestSuffixes) -> list[tuple[int, int, int, str, int]]:
    """Longest verbatim matches (document, place, words, item, place in the item), from the occurrences of windows."""
    rows = sorted((int(d), int(tests.item[x]), int(p) - int(tests.start[x]), int(p), int(tests.start[x]), int(tests.lengths[w])) for d, w, p in zip(doc, window, at, strict=True) for x in range(tests.edges[w], tests.edges[w + 1]))
    out: list[list] = []
    for d, item, shift, p, a, length in rows:
        last = out[-1] if out else None
        if last and last[:3] == [d, item, shift] and p <= last[3] + last[5] - length + 1:
            last[5] = max(last[5], p + length - last[3])
        else:
            out.append([d, item, shift, p, a, length])
    return [(d, p, length, tests.names[item], a) for d, item, _, p, a, length in out]


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[TestSuffixes]:
    """The test items in blocks of about block_bytes of text, one at a time, so that what is gathered and sent is bounded."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.encode("text", "UTF-8").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield TestSuffixes([(r.item_id, None if r.text is None else bytes(r.text)) for r in part.collect()], window)


def _texts(table: pa.Table, name: str = "text") -> list[bytes | None]:
    column = table[name]
    return (pc.cast(column, pa.large_binary()) if pa.types.is_large_string(column.type) else pc.cast(column, pa.binary())).to_pylist()


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, doc_start, n_words, item_id, item_start: the longest verbatim matches of at least a window.

    Starts count words from 0. An item of fewer words than a window must match as a whole. Null texts have no words. A
    repeated document or item gets matches of its own. Items come in blocks (one pass over the documents each), so no
    match is cut: a block holds whole items.
    """
    out = None
    for tests in blocks_of(benchmark, window, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for shard in chunks(batches, SHARD_BYTES):
                _, doc, found, at = search(_texts(shard), sent.value)
                ids = shard["doc_id"].to_pylist()
                rows = maximal(doc, found, at, sent.value)
                for k in range(0, len(rows), 10_000):
                    d, p, n, item, a = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[x] for x in d], pa.int64()), "doc_start": p, "n_words": n, "item_id": item, "item_start": a})

        found = bounded_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCH)
        out = found if out is None else out.unionByName(found)
    return out


def _digest(ids: list, rows: list[tuple[int, np.ndarray, np.ndarray, list[str]]], share: int) -> pa.RecordBatch:
    hits = [covered(at, n, size) for size, at, n, _ in rows]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([r[0] for r in rows], pa.int64()), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(r[3]) for r in rows], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(r[3]).encode()).hexdigest() for r in rows]), "contaminated": pa.array([h > 0 and share * h >= r[0] for h, r in zip(hits, rows, strict=True)]),
    })


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _spans(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """rows (row, text) to row, n_words, at, n, items: the spans of all occurrences (starts and lengths) and the items.

    Each block of items is one pass over the rows; its finds are written at once, so one block at a time is in memory.
    """
    spans = None
    for tests in blocks_of(benchmark, window, block_bytes):
        sent = rows.sparkSession.sparkContext.broadcast(tests)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for shard in chunks(batches, SHARD_BYTES):
                got = judged(_texts(shard), sent.value)
                hit = pa.array([len(x[1]) > 0 for x in got])
                columns = {"n_words": pa.array([x[0] for x in got], pa.int64()), "at": pa.array([x[1] for x in got], pa.list_(pa.int64())), "n": pa.array([x[2] for x in got], pa.list_(pa.int64())), "items": pa.array([x[3] for x in got], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict({"row": shard["row"].combine_chunks()} | columns).filter(hit)

        part = written(rows.mapInArrow(find, "row long, n_words long, at array<long>, n array<long>, items array<string>"))
        sent.destroy()
        spans = part if spans is None else spans.unionByName(part)
    return spans.groupBy("row").agg(F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("at", "n", "items")))


def _in_one_block(benchmark: DataFrame, window: int, block_bytes: int) -> TestSuffixes | None:
    blocks = blocks_of(benchmark, window, block_bytes)
    first = next(blocks)
    return first if next(blocks, None) is None else None


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: n_words, n_hit (words inside a match), n_items, items_sha256, contaminated (share * n_hit >= n_words > 0).

    Null and empty texts have no words and are clean. Null doc_ids and repeated rows are judged row by row. Items with a
    null id count as one item with an empty id. A benchmark of one block needs no shuffle; beyond that the rows are numbered
    and the finds of all blocks are put together by row, with the same results.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tests = _in_one_block(benchmark, window, block_bytes)
    if tests is not None:
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in chunks(batches, SHARD_BYTES):
                yield _digest(shard["doc_id"].to_pylist(), judged(_texts(shard), sent.value), share)

        return rows.mapInArrow(run, DIGEST)
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()))
    joined = numbered.join(_spans(numbered.select("row", "text"), benchmark, window, block_bytes).drop("n_words"), "row", "left")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            d = x.to_pydict()
            found = [(len(words(t.encode()) if t else []), np.array(a or [], np.int64), np.array(n or [], np.int64), sorted(set(i or []))) for t, a, n, i in zip(d["text"], d["at"], d["n"], d["items"], strict=True)]
            yield _digest(d["doc_id"], found, share)

    return joined.select("doc_id", "text", "at", "n", "items").mapInArrow(join, DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, judged row by row as in report(), however many
    blocks the benchmark has."""

    def clean(found: tuple[int, np.ndarray, np.ndarray]) -> bool:
        size, at, n = found[:3]
        hit = covered(at, n, size)
        return not (hit > 0 and share * hit >= size)

    tests = _in_one_block(benchmark, window, block_bytes)
    if tests is not None:
        sent = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in chunks(batches, SHARD_BYTES):
                yield from shard.filter(pa.array([clean(x) for x in judged(_texts(shard), sent.value)], pa.bool_())).to_batches()

        return bounded_batches(docs).mapInArrow(run, docs.schema)
    # Own names, so that no column of docs clashes.
    numbered = written(bounded_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")))

    def dirty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            d = x.to_pydict()
            gone = [not clean((s, np.array(a, np.int64), np.array(n, np.int64))) for s, a, n in zip(d["n_words"], d["at"], d["n"], strict=True)]
            yield x.select(["row"]).filter(pa.array(gone, pa.bool_()))

    spans = _spans(numbered.select("row", F.col("doc.text").alias("text")), benchmark, window, block_bytes)
    gone = spans.select("row", "n_words", "at", "n").mapInArrow(dirty, "row long")
    return numbered.join(gone, "row", "left_anti").select("doc.*")
