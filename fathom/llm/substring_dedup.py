"""Substring dedup by relative Lempel-Ziv parsing over reference blocks.

The contents that meet under an anchor are a reference block (see repeats.py). Each is factored greedily against the
block: at a position where the index of windows knows another occurrence, the factor runs on as long as the text and that
occurrence agree. A factor of at least a window is a duplicate span. As a greedy factor may end in the middle of another
repeat, the windows over its end are looked up anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Kind, PrefixHash, mixed, remove_repeats

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def word_symbols(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Block:
    """A reference block: some texts (lists of words) with the number of their occurrences, indexed by windows."""

    def __init__(self, texts: list[list[bytes]], times: np.ndarray, window: int):
        self.window = window
        numbers: dict[bytes, int] = {}
        self.lengths = np.array([len(x) for x in texts], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.ids = np.array([numbers.setdefault(w, len(numbers)) for x in texts for w in x], np.int64)
        self.end = np.repeat(self.first + self.lengths, self.lengths)
        text = np.repeat(np.arange(len(texts)), self.lengths)
        self.hash = PrefixHash(mixed((self.ids + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        self.heads = np.flatnonzero(np.arange(len(self.ids)) + window <= self.end)
        order, edges = self._equal_windows()
        size = np.diff(edges)
        sums = np.add.reduceat(times[text[self.heads[order]]], edges[:-1]) if len(order) else np.zeros(0, np.int64)
        #: Per position: another occurrence of its window (its own, if its text occurs again), or -1.
        self.source = np.full(len(self.ids) + 1, -1, np.int64)
        inside = np.arange(len(order)) - np.repeat(edges[:-1], size)
        other = np.repeat(edges[:-1], size) + (inside + 1) % np.repeat(size, size)
        known = np.repeat(sums, size) > 1
        self.source[self.heads[order[known]]] = self.heads[order[other[known]]]

    def _equal_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows in an order that puts equal ones together, and where each set begins; equality is checked word by word."""
        if not len(self.heads):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        h = self.hash.at(self.heads, self.window)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        at, to = self.heads[order[1:][same]], self.heads[order[:-1][same]]
        if any((self.ids[at + k] != self.ids[to + k]).any() for k in range(self.window)):  # two windows of one hash
            rows = np.lib.stride_tricks.sliding_window_view(self.ids, self.window)[self.heads]
            order = np.lexsort(rows.T[::-1])
            same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        return order, np.r_[0, np.flatnonzero(~same) + 1, len(order)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that agree from a and from b on, by binary search over prefix hashes."""
        low, high = np.full(len(a), self.window), np.minimum(self.end[a] - a, self.end[b] - b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            agree = self.hash.at(a, mid) == self.hash.at(b, mid)
            low, high = np.where(agree, mid, low), np.where(agree, high, mid - 1)
        return low

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, source, words) of the factors of at least a window, all texts side by side."""
        n = len(self.ids)
        hit = np.where(self.source[:n] >= 0, np.arange(n), n)
        following = np.minimum.accumulate(np.r_[hit, n][::-1])[::-1]
        at, out = self.first[self.lengths > 0], []
        stop = (self.first + self.lengths)[self.lengths > 0]
        while len(at):
            at = following[at]
            open_ = at < stop
            at, stop = at[open_], stop[open_]
            if not len(at):
                break
            source = self.source[at]
            size = np.where(source == at, stop - at, self.common(at, source))
            size = np.where(source == at, np.minimum(size, self._own(at)), size)
            out.append((at, source, size))
            at = np.minimum(at + size - self.window + 1, n)  # the windows over the factor's end
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _own(self, at: np.ndarray) -> np.ndarray:
        """A text that occurs again repeats up to its end."""
        return self.end[at] - at


def judge(window: int):
    def run(contents: list[bytes], least: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        texts = [x.split(b" ") for x in contents]
        block = Block(texts, times, window)
        start, _, size = block.factors()
        steps = np.zeros(len(block.ids) + 1, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, start + size - window + 1, -1)
        flags = np.cumsum(steps[:-1]) > 0
        return [flags[a : a + n - window + 1] for a, n in zip(block.first, block.lengths, strict=True)]

    return run


def finish(words: list[bytes], gone: np.ndarray) -> tuple:
    hit = int(gone.sum())
    kept = words if not hit else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), hit, b" ".join(kept).decode("utf-8", "replace")


def kind(window: int, gram: int = 10) -> Kind:
    return Kind(window, gram, 5, True, lambda x: x.split(), word_symbols, lambda u, a, n: b" ".join(u[a : a + n]), judge(window), finish)


def dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each row of docs: words inside a window that starts anywhere else, too, go.

    Words are parted by ASCII white space and kept by one space each. Null and empty texts have no words. Null ids are
    taken as they are; repeated rows repeat each other and so lose all windows. Windows are judged on the input. Texts
    shorter than a window stay. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return remove_repeats(rows, kind(window), "doc_id long, n_words long, n_removed long, kept string", SCHEMA)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def digest(docs: DataFrame, window: int = 35) -> DataFrame:
    """As dedup(), with the SHA-256 of the kept text instead of it."""
    k = kind(window)
    k.finish = lambda u, gone: (*(x := finish(u, gone))[:2], hashlib.sha256(x[2].encode()).hexdigest())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return remove_repeats(rows, k, "doc_id long, n_words long, n_removed long, kept_sha256 string", DIGEST)
