"""Suffix-array dedup: a suffix sort that compares by hashes.

The contents that meet under an anchor (see repeats.py) are sorted by the suffixes that begin at their windows. Prefix
polynomial hashes give the hash of any stretch; a binary search over its length finds how far two suffixes agree, so one
comparison takes logarithmically many steps. The sort is a mergesort: suffixes are first put in order of their leading
eight bytes, those that tie are merged in runs of doubling length, where each finds its place in the other run by binary
search. Neighbours that agree on a whole window are then compared byte by byte; if the hashes misled, another base is taken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import LAST, Kind, Powers, PrefixHash, mixed, remove_repeats

BYTE_SYMBOLS = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, Powers] = {}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


class Suffixes:
    """Suffixes of a text of bytes, each cut at `cap` bytes. The text must hold `cap` bytes from every start."""

    def __init__(self, text: np.ndarray, cap: int, powers: Powers):
        self.text, self.cap = text, cap
        padded = np.r_[text, np.zeros(8, np.uint8)]
        self.lead = np.zeros(len(text), np.uint64)
        for k in range(8):
            self.lead = self.lead << np.uint64(8) | padded[k : k + len(text)]
        self.hash = PrefixHash(BYTE_SYMBOLS[text], powers)
        self.whole = np.zeros(len(text), np.uint64)
        if len(text) >= cap:
            self.whole[: len(text) - cap + 1] = self.hash.every(cap)

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of bytes, up to cap, that the suffixes at a and b have in common."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.cap)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.at(a, mid) == self.hash.at(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which suffixes at a come before those at b, and which are equal."""
        equal = self.whole[a] == self.whole[b]
        out = np.zeros(len(a), bool)
        rest = np.flatnonzero(~equal)
        x, y = a[rest], b[rest]
        n = np.minimum(self.agree(x, y), self.cap - 1)
        out[rest] = self.text[x + n] < self.text[y + n]
        return out, equal

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """starts in the order of their suffixes; equal ones in the order given."""
        order = starts[np.argsort(self.lead[starts], kind="stable")]
        lead = self.lead[order]
        heads = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])
        sizes = np.diff(np.r_[heads, len(order)])
        tied = sizes > 1
        heads, sizes = heads[tied], sizes[tied]
        if not len(heads):
            return order
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # in the tie
        base, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        width = 1
        while len(place):
            block = place // width
            low = np.minimum((block ^ 1) * width, size)
            begin, high = low.copy(), np.minimum(low + width, size)
            own = order[base + place]
            right = block % 2 == 1
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                other = order[base[open_] + mid]
                before, equal = self.less(other, own[open_])
                up = before | (equal & right[open_])
                low[open_], high[open_] = np.where(up, mid + 1, low[open_]), np.where(up, high[open_], mid)
            new = (block // 2) * 2 * width + (place - block * width) + (low - begin)
            order[base + new] = own
            width *= 2
            more = size > width
            if not more.all():
                base, size, place = base[more], size[more], place[more]  # order holds them; places are dealt anew
                place = np.arange(len(place)) - np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], np.arange(len(place)), 0)) if len(place) else place
        return order

    def same_as_before(self, order: np.ndarray) -> np.ndarray | None:
        """For each suffix in order whether it equals the one before; None if hashes say so and the bytes do not."""
        a, b = order[1:], order[:-1]
        same = np.r_[False, self.whole[a] == self.whole[b]]
        a, b = a[same[1:]], b[same[1:]]
        for k in [*range(0, self.cap - 7, 8), self.cap - 8] if self.cap >= 8 else []:
            if (self.lead[a + k] != self.lead[b + k]).any():
                return None
        return same


def equal_sets(contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all contents: their contents, their order as suffixes, and where in it each set of equal ones begins."""
    text = np.frombuffer(b"".join(contents), np.uint8)
    lengths = np.array([len(x) for x in contents], np.int64)
    count = lengths - window + 1
    owner = np.repeat(np.arange(len(contents)), count)
    first = np.cumsum(lengths) - lengths
    starts = np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    number = np.full(len(text), -1, np.int64)
    number[starts] = np.arange(len(starts))
    for base in BASES:
        suffixes = Suffixes(text, window, _POWERS.setdefault(base, Powers(base | 1)))
        order = suffixes.sort(starts)
        same = suffixes.same_as_before(order)
        if same is not None:
            return owner, number[order], np.flatnonzero(~same)
    raise ValueError("all bases misled")  # three independent hashes of 64 bits would have to collide


def judge(window: int):
    def run(contents: list[bytes], least: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        owner, order, heads = equal_sets(contents, window)
        own = least[owner]
        lowest = np.minimum.reduceat(own[order], heads) if len(heads) else own[:0]
        flags = np.zeros(len(order), bool)
        flags[order] = np.repeat(lowest, np.diff(np.r_[heads, len(order)])) < own[order]
        edges = np.cumsum([len(x) - window + 1 for x in contents])
        return np.split(flags, edges[:-1])

    return run


def finish(text: bytes, gone: np.ndarray) -> tuple:
    hit = int(gone.sum())
    if not hit:
        return len(text), 0, 0, text
    spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
    return len(text), hit, spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def kind(window: int, gram: int = 22) -> Kind:
    return Kind(window, gram, 7, False, bytes, lambda x: BYTE_SYMBOLS[np.frombuffer(x, np.uint8)], lambda u, a, n: u[a : a + n], judge(window), finish)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of docs: bytes inside a window of `window` bytes that
    also starts in a document with a smaller doc_id go.

    Null and empty texts have no bytes; texts shorter than a window stay. A null id counts as larger than all others.
    Rows that share a doc_id take nothing from each other. Windows are judged on the input. Other columns are not read.
    """
    return remove_repeats(_rows(docs), kind(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", SCHEMA)


DIGEST = pa.schema([*list(SCHEMA)[:4], ("kept_sha256", pa.string())])


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """As dedup(), with the SHA-256 of the kept bytes instead of them."""
    k = kind(window)
    k.finish = lambda u, gone: (*(x := finish(u, gone))[:3], hashlib.sha256(x[3]).hexdigest())
    return remove_repeats(_rows(docs), k, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", DIGEST)


CUT = pa.schema([("row", pa.null()), ("changed", pa.bool_()), ("text", pa.string())])


def cut_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """The rows of docs, with all their columns, without the bytes that dedup() removes.

    A row that loses its whole text goes. Where a text changed and there is a column n_chars, it is counted anew. Characters
    of which a part was cut go as a whole. Null texts stay null; rows and nulls are otherwise treated as in dedup().
    """
    k = kind(window)
    k.finish = lambda u, gone: (bool(gone.any()), np.frombuffer(u, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else None)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    kind_of_row = rows.schema["row"].dataType.simpleString()
    found = remove_repeats(rows, k, f"row {kind_of_row}, changed boolean, text string", CUT)
    text = F.when(F.col("changed"), F.col("text")).otherwise(F.col("row.text"))
    columns = {"text": text, "n_chars": F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    left = found.where(~F.col("changed") | (F.col("text") != ""))
    return left.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
