"""Routing of repeated windows: what substring and suffix-array dedup share.

A window is a fixed number of symbols (words or bytes) in a row. The corpus is dealt to shards of bounded size.

1. A shard cuts its texts into chunks where the content says so. A chunk, with all of the windows that begin in it, is known
   by a cryptographic digest of 128 bits. Each window also has an anchor: the least hash among its short grams. Equal windows
   have equal anchors wherever they stand; neighbours mostly share one, so a chunk falls into runs of windows with one anchor.
   Digests and anchors go, packed, to buckets by hash. A bucket settles equal chunks (long repeats; only the first takes
   part in what follows) and tells each shard which of its anchors others hold, too, and which are hot.
2. Each shard sends the runs of these anchors, once for each distinct content, with the text that their windows span. All
   runs of an anchor meet in one task, which judges their windows (the operators differ here). The windows of a hot anchor
   are sent one by one and meet by the hash of the whole window, so a phrase that a third of all documents hold in different
   surroundings is spread over all tasks.
3. Each shard takes the judgements back and applies them to its documents.

The documents are shuffled once: all steps read the same exchange. Copies are reduced to one row for each shard and content
before anything is shuffled, so a passage in a third of all documents sends at most as many rows as there are shards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hand_back

BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = 1 << 18  # windows worked on at once
ANCHOR_BYTES = 6
SETTLED, OPEN = 1, 2
HOT_RUNS, HOT_A_SHARD = 10_000, 2  # an anchor with more runs than both (the second for each shard) is hot


class Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""

    def __init__(self, base: int = BASE):
        self.base = base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(self.base, -1, 1 << 64), np.uint64)])


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class PrefixHash:
    """Prefix sums of symbols times powers of the base; any stretch of the sequence gets a hash in constant time."""

    def __init__(self, symbols: np.ndarray, powers: Powers = POWERS):
        powers.reach(len(symbols) + 1)
        self.powers = powers
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * powers.up[: len(symbols)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Hashes of all stretches of a size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.powers.down[:n]

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.powers.down[start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[: len(x) - step], x[step:])
        size += step
    return x


@dataclass
class Runs:
    """Runs of windows with one anchor in one chunk: document (place in the list), first window, number of windows, chunk
    (place in the list of chunks); whether the anchor's gram stands at several places in the run, so that the run may hold a
    window twice."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    doubled: np.ndarray
    chunk: np.ndarray


@dataclass
class Chunks:
    """Document, first window and number of windows of each chunk."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray


def cut_up(docs: Iterable[np.ndarray], window: int, gram: int, chunk_bits: int, want_doubled: bool = False) -> tuple[Chunks, Runs]:
    """Chunks and runs of all windows of the documents' symbols (64-bit, spread evenly). Long documents are worked on in
    segments; a segment's begin is a cut, too, which does no harm."""
    out_chunks: list[tuple] = []
    out_runs: list[tuple] = []
    group: list[tuple[int, int, np.ndarray]] = []
    size = chunks_before = 0
    mask = np.uint64((1 << chunk_bits) - 1)

    def flush() -> None:
        nonlocal group, size, chunks_before
        if not group:
            return
        symbols = np.concatenate([x[2] for x in group])
        lengths = np.array([len(x[2]) for x in group])
        number, origin = np.array([x[0] for x in group]), np.array([x[1] for x in group])
        first = np.cumsum(lengths) - lengths
        h = mixed(PrefixHash(symbols).every(gram))
        n = len(symbols) - window + 1
        piece = np.repeat(np.arange(len(group)), lengths)[:n]
        place = np.arange(n) - first[piece]
        valid = place + window <= lengths[piece]
        total = np.cumsum(valid)
        cut = valid & ((place == 0) | (h[:n] & mask == 0))

        def stretches(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            heads = np.flatnonzero(new)
            return heads, np.diff(np.r_[total[heads] - 1, total[-1]])

        heads, count = stretches(cut)
        out_chunks.append((number[piece[heads]], place[heads] + origin[piece[heads]], count))
        wide = window - gram + 1
        least = sliding_min(h, wide)
        new = cut.copy()
        new[1:] |= valid[1:] & (least[1:] != least[:-1])
        runs, count = stretches(new)
        doubled = np.zeros(len(runs), bool)
        if want_doubled:  # the gram's places in the run: those of its windows' grams that equal the anchor
            run = np.repeat(np.arange(len(runs)), count)
            inside = np.flatnonzero(valid)
            hits = np.bincount(run[h[inside] == least[inside]], minlength=len(runs)).astype(np.int64)
            tail = runs + count
            for k in range(wide - 1):
                hits += h[np.minimum(tail + k, len(h) - 1)] == least[runs]
            doubled = hits > 1
        out_runs.append((number[piece[runs]], place[runs] + origin[piece[runs]], count, least[runs], doubled, np.searchsorted(heads, runs, "right") - 1 + chunks_before))
        chunks_before += len(heads)
        group, size = [], 0

    for k, x in enumerate(docs):
        for a in range(0, max(0, len(x) - window + 1), SEGMENT):
            group.append((k, a, x[a : a + SEGMENT + window - 1]))
            size += len(group[-1][2])
            if size >= SEGMENT:
                flush()
    flush()
    none = np.zeros(0, np.int64)
    chunks = Chunks(*(np.concatenate(x) for x in zip(*out_chunks, strict=True))) if out_chunks else Chunks(none, none, none)
    return chunks, Runs(*(np.concatenate(x) for x in zip(*out_runs, strict=True))) if out_runs else Runs(none, none, none, none.astype(np.uint64), none.astype(bool), none)


def key_of(anchor: np.ndarray) -> np.ndarray:
    """The anchor without its last bits; enough to tell which runs must meet. Never 0, which marks other rows."""
    return anchor >> np.uint64(64 - 8 * ANCHOR_BYTES) | np.uint64(1)


def packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // ANCHOR_BYTES, 8), np.uint8)
    out[:, :ANCHOR_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, ANCHOR_BYTES)
    return out.view("<u8").ravel()


@dataclass
class Kind:
    """What an operator does with the windows.

    units and symbols of a text; span: the bytes of some units in a row; judge: contents of all runs of some anchors, with
    the least document and the number of occurrences for each, to flags for each window of each; finish: a document's units
    and which of them go, to the columns of the result.
    """

    window: int
    gram: int
    chunk_bits: int
    within: bool  # whether a repeat in the same document counts
    units: Callable[[bytes], object]
    symbols: Callable[[object], np.ndarray]
    span: Callable[[object, int, int], bytes]
    judge: Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]
    finish: Callable[[object, np.ndarray], tuple]


LAST = 2**63 - 1  # stands for a null id


TOLD = "shard long, anchor long, content long, flags binary"
CHUNK_FLAGS, SHARED, HOT = -1, -2, -3  # what a row of TOLD holds, instead of an anchor


def told_rows(shards: list[int], kind: int, flags: list[bytes]) -> pa.Table:
    n = len(shards)
    return pa.table({"shard": pa.array(shards, pa.int64()), "anchor": pa.array(np.full(n, kind, np.int64)), "content": pa.array(np.zeros(n, np.int64)), "flags": pa.array(flags, pa.binary())})


def in_order(table: pa.Table) -> pa.Table:
    """A shard's rows in the order that all steps count them in; rows come in any order. Rows that tie are alike."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


class Shard:
    """The documents of a shard (rows in_order), cut up. told: what buckets have said about its chunks and anchors (None in the first step)."""

    def __init__(self, table: pa.Table, kind: Kind, told: pa.Table | None = None):
        self.shard, self.kind = table["shard"][0].as_py(), kind
        self.ids = np.array([LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        self.units = [kind.units(x or b"") for x in table["text"].to_pylist()]
        self.chunks, self.runs = cut_up((kind.symbols(u) for u in self.units), kind.window, kind.gram, kind.chunk_bits, want_doubled=kind.within and told is None)
        if told is None:
            return
        flags, kinds = told["flags"].to_pylist(), told["anchor"].to_numpy()
        said = [np.frombuffer(flags[k], np.uint8).reshape(-1, 5) for k in np.flatnonzero(kinds == CHUNK_FLAGS)]
        rows = np.concatenate([np.zeros((0, 5), np.uint8), *said])
        got = np.zeros(len(self.chunks.doc), np.uint8)
        got[np.ascontiguousarray(rows[:, :4]).view("<u4").ravel()] = rows[:, 4]
        self.settled = np.flatnonzero(got & SETTLED)
        keys = key_of(self.runs.anchor)
        shared, hot = (np.concatenate([np.zeros(0, np.uint64), *(unpacked(flags[k]) for k in np.flatnonzero(kinds == x))]) for x in (SHARED, HOT))
        at = np.flatnonzero(got[self.runs.chunk] & OPEN) if len(got) else np.zeros(0, np.int64)
        self.at = at[np.isin(keys[at], shared)]
        self.keys, self.is_hot = keys[self.at], np.isin(keys[self.at], hot)

    def spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """The runs that take part, windows of hot anchors each for itself: document, first window, number, key, content."""
        r, window, span = self.runs, self.kind.window, self.kind.span
        cold, hot = self.at[~self.is_hot], self.at[self.is_hot]
        n = r.count[hot]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc = np.r_[r.doc[cold], np.repeat(r.doc[hot], n)]
        start = np.r_[r.start[cold], np.repeat(r.start[hot], n) + inside]
        count = np.r_[r.count[cold], np.ones(len(inside), np.int64)]
        content = [span(self.units[d], a, k + window - 1) for d, a, k in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True)]
        own = np.fromiter((xxhash.xxh64_intdigest(x) for x in content[len(cold) :]), np.uint64, len(inside))
        return doc, start, count, np.r_[self.keys[~self.is_hot], key_of(own)], content

    def numbered(self) -> tuple[tuple[np.ndarray, ...], np.ndarray, list[int]]:
        """spread(), for each of its rows the number of its key and content among the distinct ones (in the order of their
        first rows, the same in each step), and the place of the first row of each number."""
        rows = self.spread()
        found: dict[tuple[int, bytes], int] = {}
        number = np.fromiter((found.setdefault(x, len(found)) for x in zip(rows[3].tolist(), rows[4], strict=True)), np.int64, len(rows[4]))
        first = np.full(len(found), len(number), np.int64)
        np.minimum.at(first, number, np.arange(len(number)))
        return rows, number, first.tolist()


OFFER = "bucket long, shard long, digests binary, ids binary, places binary, alone binary, several binary, counts binary"


def _offers(kind: Kind, buckets: int):
    """Step 1: the shard's chunks (digest, document, place) and its distinct anchors, packed by bucket; anchors of several
    runs come apart, with the number of runs (to 255)."""

    def run(table: pa.Table) -> pa.Table:
        s = Shard(in_order(table), kind)
        c, r = s.chunks, s.runs
        digest, span, extra = hashlib.blake2b, kind.span, kind.window - 1
        digests = b"".join([digest(span(s.units[d], a, n + extra), digest_size=16).digest() for d, a, n in zip(c.doc.tolist(), c.start.tolist(), c.count.tolist(), strict=True)])
        words = np.frombuffer(digests, "<u8").reshape(-1, 2)
        order, edges = dealt_by((words[:, 0] % np.uint64(buckets)).astype(np.int64), buckets)
        raw = np.frombuffer(digests, np.uint8).reshape(-1, 16)[order], s.ids[c.doc[order]].astype("<i8"), order.astype("<u4")
        # Of equal chunks in the shard one is enough for the anchors; a run may hold a window twice.
        _, firsts = np.unique(words.view([("a", "<u8"), ("b", "<u8")]).ravel(), return_index=True)
        chosen = np.zeros(len(c.doc), bool)
        chosen[firsts] = True
        at = np.flatnonzero(chosen[r.chunk]) if len(chosen) else np.zeros(0, np.int64)
        keys, of = key_of(r.anchor[at]), r.doc[at]
        if kind.within:
            keys = np.r_[keys, keys[r.doubled[at]]]
        else:  # repeats in one document do not count
            order = np.lexsort((of, keys))
            keys, of = keys[order], of[order]
            keys = keys[np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])][: len(keys)]]
        keys, count = np.unique(keys, return_counts=True)
        parts = []
        for some in (count == 1, count > 1):
            own, e = dealt_by((keys[some] // np.uint64(2) % np.uint64(buckets)).astype(np.int64), buckets)  # all keys are odd
            parts.append((keys[some][own], np.minimum(count[some][own], 255).astype(np.uint8), e))
        out: dict[str, list] = {x.split()[0]: [] for x in OFFER.split(", ")}
        for b in range(buckets):
            i, j = edges[b], edges[b + 1]
            (alone, _, p), (several, counts, q) = parts
            if i < j or p[b] < p[b + 1] or q[b] < q[b + 1]:
                row = b, s.shard, *(x[i:j].tobytes() for x in raw), packed(alone[p[b] : p[b + 1]]), packed(several[q[b] : q[b + 1]]), counts[q[b] : q[b + 1]].tobytes()
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
        hand_back()
        return pa.table({k: pa.array(x, pa.int64() if k in ("bucket", "shard") else pa.binary()) for k, x in out.items()})

    return run


def dealt_by(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int]]:
    """An order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()


def _answers(kind: Kind, hot_runs: int):
    """Step 1, in a bucket: for each shard its chunks (settled, open), those of its anchors that are shared, and hot ones."""

    def run(table: pa.Table) -> pa.Table:
        column = {c: table[c].to_pylist() for c in table.column_names}
        shards = column["shard"]
        sizes = np.array([len(x) // 8 for x in column["ids"]])
        words, ids = np.frombuffer(b"".join(column["digests"]), "<u8").reshape(-1, 2), np.frombuffer(b"".join(column["ids"]), "<i8")
        order = np.lexsort((np.repeat(np.arange(len(sizes)), sizes), ids, words[:, 1], words[:, 0]))
        w = words[order]
        new = np.r_[True, (w[1:] != w[:-1]).any(axis=1)][: len(w)]
        heads = np.flatnonzero(new)
        n = np.diff(np.r_[heads, len(w)])
        flags = np.zeros(len(w), np.uint8)
        if kind.within:  # all of equal chunks go; the first stays in, for windows that it shares with others
            flags[order] = np.where(np.repeat(n, n) > 1, SETTLED, OPEN)
            flags[order[heads]] |= OPEN
        else:
            flags[order] = np.where(np.repeat(ids[order[heads]], n) < ids[order], SETTLED, OPEN)
        places = np.frombuffer(b"".join(column["places"]), np.uint8).reshape(-1, 4)
        rows = np.concatenate([places, flags[:, None]], axis=1)
        ends = np.cumsum(sizes)
        out = [told_rows(shards, CHUNK_FLAGS, [rows[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)])]

        alone, several = ([unpacked(x) for x in column[c]] for c in ("alone", "several"))
        counts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in column["counts"]]
        both = [np.concatenate(x) for x in zip(alone, several, strict=True)]
        every, weight = np.concatenate(both), np.concatenate([x for k, n in zip(alone, counts, strict=True) for x in (np.ones(len(k), np.int64), n)])
        order = np.argsort(every)
        values = every[order]
        heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
        total = np.zeros(len(every), np.int64)
        if len(heads):
            total[order] = np.repeat(np.add.reduceat(weight[order], heads), np.diff(np.r_[heads, len(values)]))
        edges = np.cumsum([len(x) for x in both])[:-1]
        for what, some in ((SHARED, total > 1), (HOT, total > hot_runs)):
            got = [(s, packed(x[f])) for s, x, f in zip(shards, both, np.split(some, edges), strict=True) if f.any()]
            out.append(told_rows([x[0] for x in got], what, [x[1] for x in got]))
        return pa.concat_tables(out).combine_chunks()

    return run


CONTENT = "anchor long, shard long, number long, content binary, least long, times long"


def _contents(kind: Kind):
    """Step 2: each distinct content of the runs of shared anchors, with its least document and its number of places."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        shard, rows, number, first, ids = 0, ([],) * 5, np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        if table.num_rows:
            s = Shard(in_order(table), kind, told)
            rows, number, first = s.numbered()
            shard, ids = s.shard, s.ids[rows[0]]
        hand_back()
        least = np.full(len(first), LAST)
        np.minimum.at(least, number, ids)
        key = np.asarray(rows[3], np.uint64)[first].astype(np.int64) if first else np.zeros(0, np.int64)
        return pa.table({
            "anchor": pa.array(key), "shard": pa.array(np.full(len(first), shard, np.int64)), "number": pa.array(np.arange(len(first))), "content": pa.array([rows[4][k] for k in first], pa.binary()),
            "least": pa.array(least), "times": pa.array(np.bincount(number, minlength=len(first)).astype(np.int64)),
        })

    return run


def _judgements(kind: Kind, most_bytes: int = 1 << 18):
    """Step 2, where all contents of an anchor are: flags for the windows of each content, for the shard that sent it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            flags = kind.judge(t["content"].to_pylist(), t["least"].to_numpy(), t["times"].to_numpy())
            some = [k for k, f in enumerate(flags) if f.any()]
            return pa.RecordBatch.from_arrays([t["shard"].combine_chunks().take(pa.array(some, pa.int64())), pa.array(np.zeros(len(some), np.int64)), t["number"].combine_chunks().take(pa.array(some, pa.int64())), pa.array([np.packbits(flags[k]).tobytes() for k in some], pa.binary())], names=["shard", "anchor", "content", "flags"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most_bytes and held[0]["anchor"][0] != held[-1]["anchor"][-1]:
                t = pa.Table.from_batches(held)
                anchors = t["anchor"].to_numpy()
                end = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on
                yield solve(t.slice(0, end))
                held, size = t.slice(end).combine_chunks().to_batches(), t.slice(end).nbytes
        if held:
            yield solve(pa.Table.from_batches(held))
        hand_back()

    return run


def _results(kind: Kind, schema: pa.Schema):
    """Step 3: the flags of all windows of a shard's documents, and what follows from them."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([table[0].combine_chunks(), *(pa.array([], f.type) for f in list(schema)[1:])], names=schema.names)
        table = in_order(table)
        s = Shard(table, kind, told)
        (doc, start, count, _, _), number, first = s.numbered()
        judged = np.flatnonzero(told["anchor"].to_numpy() == 0)
        bits, of = told["flags"].take(pa.array(judged)).to_pylist(), told["content"].to_numpy()[judged]
        flags: list[bytes | None] = [None] * len(first)
        for k, x in zip(of.tolist(), bits, strict=True):
            flags[k] = x
        c = s.chunks
        hit_doc, hit_start, hit_count = [c.doc[s.settled]], [c.start[s.settled]], [c.count[s.settled]]
        if not kind.within:  # a smaller document of the shard has the content
            least = np.full(len(first), LAST)
            np.minimum.at(least, number, s.ids[doc])
            later = least[number] < s.ids[doc]
            for x, y in zip((hit_doc, hit_start, hit_count), (doc, start, count), strict=True):
                x.append(y[later])
        else:
            later = np.zeros(len(number), bool)
        ones: list[list[np.ndarray]] = [[] for _ in s.units]
        known = np.array([x is not None for x in flags], bool)
        for k in np.flatnonzero(known[number] & ~later).tolist() if len(number) else []:
            n = int(count[k])
            ones[doc[k]].append(np.flatnonzero(np.unpackbits(np.frombuffer(flags[number[k]], np.uint8), count=n)) + start[k])
        hit_doc, hit_start, hit_count = (np.concatenate(x) for x in (hit_doc, hit_start, hit_count))
        order, edges = dealt_by(hit_doc, len(s.units))
        hit_start, hit_count = hit_start[order], hit_count[order]
        out = []
        for d, (u, parts) in enumerate(zip(s.units, ones, strict=True)):
            n, (a, b) = len(u), (edges[d], edges[d + 1])
            if a == b and not parts:
                out.append(kind.finish(u, np.zeros(n, bool)))
                continue
            single = np.concatenate([np.zeros(0, np.int64), *parts])
            begin, end = np.r_[hit_start[a:b], single], np.r_[hit_start[a:b] + hit_count[a:b], single + 1] + kind.window - 1
            steps = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
            out.append(kind.finish(u, np.cumsum(steps[:n]) > 0))
        hand_back()
        head = table["row"].combine_chunks() if "row" in table.column_names else table["doc_id"].combine_chunks().cast(pa.int64())
        return pa.table([head, *(pa.array([x[k] for x in out], f.type) for k, f in enumerate(list(schema)[1:]))], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, kind: Kind, columns: str, schema: pa.Schema, shard_bytes: int = 4 << 20, hot_runs: int | None = None) -> DataFrame:
    """docs: doc_id, text (binary). The rows that finish() makes, for each row of docs. With a column row (a struct of other
    columns), that comes first in the result instead of doc_id.

    shard_bytes bounds a shard; for corpora beyond 100 GB it grows with the root of their size, and a bucket with it (four
    shards' anchors), so that the packed rows (shards by buckets) stay few and full: at 100 TB a shard has 130 MB, a bucket
    about 220 MB, a packed row some hundred bytes. hot_runs: with more runs than that an anchor is hot.
    """
    total = bounded_batches(docs).agg(F.sum(F.length("text"))).first()[0] or 0
    shard_bytes = int(shard_bytes * max(1.0, math.sqrt(total / 1e11)))
    shards = max(1, -(-total // shard_bytes))
    buckets = max(1, shards // 4)
    dealt = docs.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard")).repartition(shards, "shard")
    with_told = lambda told, f, columns: dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(f, columns)
    offers = dealt.groupBy("shard").applyInArrow(_offers(kind, buckets), OFFER)
    told = offers.groupBy("bucket").applyInArrow(_answers(kind, hot_runs or max(HOT_RUNS, HOT_A_SHARD * shards)), TOLD)
    contents = with_told(told, _contents(kind), CONTENT)
    judged = contents.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_judgements(kind), TOLD)
    return with_told(told.unionByName(judged), _results(kind, schema), columns)
