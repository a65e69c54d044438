"""SimHash near-duplicates: fingerprints, linked by a hierarchical index in Gray order.

Two of 64 bits that differ in at most d bits agree on one of d + 1 blocks of bits; so fingerprints meet under the blocks
they share (groups that stay large are cut again by the remaining bits, in the same exact way). In a group they are
sorted by Gray rank and form a tree: a node keeps the bits on which all below it agree. Pairs of nodes are compared from
the root down; the differences on shared bits add up, and a pair beyond d is dropped with all that is below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, hand_back, written
from .components import components

FANOUT = 8
FULL = (1 << 64) - 1


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of `size` words, A-Z lower-cased, joined by a space; all words, if there are fewer; none without words."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :][:n] - 1
    return [joined[a:b] for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]


def further(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes for a further word of a wide fingerprint, drawn from the first."""
    x = (hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def hashed(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    h = xxhash.xxh64_intdigest
    return np.array([h(x, 42) for x in shingles(text or b"", size)], dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A bit is set if it is set in over half of the hashes (further words: hashes drawn from them)."""
    ones = np.zeros((words, 64), np.int64)
    for k in range(0, len(hashes), 16384):
        for w in range(words):
            own = further(hashes[k : k + 16384], w) if w else hashes[k : k + 16384]
            ones[w] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes | None, size: int = 3) -> int:
    return int(wide_fingerprint(hashed(text, size), 1)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of every row. Null and empty texts have the fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                bits = np.array([fingerprint(x, size) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "doc_id long, bits long")


def gray_rank(bits: Column) -> Column:
    """The place of a code in the reflected Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, k))
    return bits


def cut(mask: int, parts: int) -> list[int]:
    """The bits outside mask, dealt to so many runs, each added to mask."""
    free = [k for k in range(64) if not mask >> k & 1]
    edges = np.linspace(0, len(free), parts + 1).astype(int)
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grouped(codes: DataFrame, distance: int, limit: int) -> DataFrame:
    """mask, value (the code's bits under mask), bits: each pair within the distance meets in at least one group.

    Groups of more than limit codes are cut again by the bits outside their mask, at most twice; a group that is still
    large then agrees on most bits and is left to the tree.
    """
    by = lambda m: F.struct(m.alias("mask"), F.col("bits").bitwiseAND(m).alias("value"))
    deal = lambda df, masks: df.select(F.explode(masks).alias("mask"), "bits").select("bits", by(F.col("mask")).alias("group")).select("group.*", "bits")
    masks = cut(0, distance + 1)
    rows = deal(codes, F.array(*(F.lit(_signed(m)) for m in masks)))
    done = []
    for _ in range(2):
        size = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"))
        large = written(size.where(F.col("n") > limit).select("mask", "value"))
        if large.isEmpty():
            break
        done.append(rows.join(large, ["mask", "value"], "left_anti"))
        finer = {m: cut(m, distance + 1) for m in masks}
        choice = F.create_map(*(x for m, f in finer.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(y)) for y in f)))))
        rows = deal(rows.join(large, ["mask", "value"], "left_semi"), choice[F.col("mask")])
        masks = [y for f in finer.values() for y in f]
    for part in done:
        rows = rows.unionByName(part)
    return rows


class GrayTree:
    """Trees over codes (rows of 64-bit words) that come group by group, each group in Gray order. groups: ascending numbers."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        #: Pairs within the distance that links() joined: they connect all that is linked.
        self.used: list[tuple[np.ndarray, np.ndarray]] = []
        self.codes = codes = codes.reshape(len(groups), -1)
        #: Per level from the leaves up: bits that all codes below share, their values, first child of each node (and an end).
        self.shared, self.value, self.first = [np.full(codes.shape, FULL, np.uint64)], [codes], [np.arange(len(codes) + 1)]
        self.group = [groups]
        self.begin = [np.arange(len(codes) + 1)]  # first leaf below each node
        while (np.diff(self.group[-1]) == 0).any():
            g, n = self.group[-1], len(self.group[-1])
            new = np.r_[True, np.diff(g) != 0]
            place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            heads = np.flatnonzero(place % FANOUT == 0)
            all_, any_ = np.bitwise_and.reduceat(self.value[-1], heads, axis=0), np.bitwise_or.reduceat(self.value[-1], heads, axis=0)
            shared = np.bitwise_and.reduceat(self.shared[-1], heads, axis=0) & ~(all_ ^ any_)
            self.value.append(all_ & shared)
            self.shared.append(shared)
            self.first.append(np.r_[heads, n])
            self.group.append(g[heads])
            self.begin.append(np.r_[self.begin[-1][heads], len(codes)])

    def links(self, distance: int, most: int = 20_000) -> np.ndarray:
        """For each code the first code (by place) that it reaches over links within the distance."""
        label = np.arange(len(self.codes))
        top = len(self.value) - 1
        roots = np.arange(len(self.value[top]))
        work = [(top, roots[k : k + most], roots[k : k + most]) for k in range(0, len(roots), most)]
        while work:
            level, a, b = work.pop()
            apart = np.bitwise_count((self.value[level][a] ^ self.value[level][b]) & self.shared[level][a] & self.shared[level][b]).sum(axis=1, dtype=np.int64)
            near = apart <= distance
            a, b = a[near], b[near]
            if level == 0:
                self._join(label, a, b)
                continue
            if len(work) > 8:  # what is connected already has nothing to add
                low, high = np.minimum.reduceat(label, self.begin[level][:-1]), np.maximum.reduceat(label, self.begin[level][:-1])
                open_ = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
                a, b = a[open_], b[open_]
            first = self.first[level]
            step = np.arange(FANOUT)
            left, right = first[a][:, None] + step, first[b][:, None] + step
            ok = (left < first[a + 1][:, None])[:, :, None] & (right < first[b + 1][:, None])[:, None, :]
            x, y = np.broadcast_to(left[:, :, None], ok.shape)[ok], np.broadcast_to(right[:, None, :], ok.shape)[ok]
            x, y = x[x <= y], y[x <= y]
            work += [(level - 1, x[k : k + most], y[k : k + most]) for k in range(0, len(x), most)]
        return label

    def _join(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((low, high))
            best = order[np.r_[True, np.diff(high[order]) != 0]]
            label[high[best]] = low[best]
            self.used.append((a[best], b[best]))
            while not np.array_equal(up := label[label], label):
                label[:] = up


def links(codes: DataFrame, distance: int = 3, limit: int = 4096, batch: int = 50_000) -> DataFrame:
    """a, b: links that connect all codes (bits, distinct longs) that differ in at most distance bits.

    A group yields a spanning forest of its links, not all pairs: at most one row for each code.
    """
    rows = grouped(codes, distance, limit).repartition("mask", "value").sortWithinPartitions("mask", "value", gray_rank(F.col("bits")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(mask: np.ndarray, value: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            groups = np.cumsum(np.r_[False, (np.diff(mask) != 0) | (np.diff(value) != 0)])
            first = GrayTree(bits.view(np.uint64), groups).links(distance)
            moved = np.flatnonzero(first != np.arange(len(first)))
            return pa.RecordBatch.from_arrays([pa.array(bits[moved]), pa.array(bits[first[moved]])], names=["a", "b"])

        held: list[np.ndarray] = []
        size = 0
        for x in batches:
            held.append(np.stack([c.to_numpy() for c in x.columns]))
            size += x.num_rows
            if size >= batch and (held[0][:2, 0] != held[-1][:2, -1]).any():
                rows = np.concatenate(held, axis=1)
                end = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[-1]) + 1  # the last group may go on
                yield solve(*(np.ascontiguousarray(c) for c in rows[:, :end]))
                held, size = [rows[:, end:]], rows.shape[1] - end
        if size:
            yield solve(*(np.ascontiguousarray(c) for c in np.concatenate(held, axis=1)))

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that it reaches over links) of every row of docs.

    Copies share a fingerprint, so only distinct fingerprints are linked; copies are not expanded into pairs. Null and
    empty texts have fingerprint 0 and link like any other. Rows with a null doc_id link, too, but give no component_id;
    it is null if all rows of a component have null ids. Repeated rows each get a row.
    """
    marks = written(fingerprints(docs, size))
    codes = marks.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = components(links(codes.select("bits"), distance))
    known = codes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("bits", "component_id")
    return marks.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def alike(docs: DataFrame, codes: DataFrame, pairs: DataFrame, size: int, similarity: Fraction) -> DataFrame:
    """Those of pairs (a, b: nodes) whose sets of shingles share at least that part. codes: node, least (a doc_id or null).

    Only documents of the nodes in question are read again; their sets go to the pairs by joins.
    """
    pairs = written(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    ids = codes.join(nodes, "node", "left_semi").select("least").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                sets = [np.unique(hashed(x, size)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "set"])

    sets = bounded_batches(texts).mapInArrow(gather, "node long, set binary").join(nodes, "node", "left_semi")
    sets = written(sets.groupBy("node").agg(F.first("set").alias("set")))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * similarity.denominator >= (len(x) + len(y) - shared) * similarity.numerator)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"))


def common_shingles(docs: DataFrame, size: int, rows: int = 8192, least: int = 3, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of shingles that many texts hold, and their ranks by frequency, from about `rows` texts.

    They only order the shingles; candidates() is exact in any order, the same one for all texts.
    """
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, docs.count() // rows))) == 0).select(F.encode("text", "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [np.unique(hashed(x, size)) for x in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    count = bounded_batches(part).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = count.orderBy(F.desc("n"), "h").limit(most).toArrow()  # most bounds what is sent
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: Fraction) -> np.ndarray:
    """The rarest shingles of a set, so many that any set similar enough has one of them among its own rarest."""
    n = len(own)
    if not n:
        return own
    h, count = common
    rank = np.zeros(n, np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, own), len(h) - 1)
        rank = np.where(h[at] == own, count[at], 0)
    return own[np.lexsort((own, rank))[: n - -(-similarity.numerator * n // similarity.denominator) + 1]]


def candidates(known: DataFrame, similarity: Fraction, batch: int = 100_000, block: int = 512) -> DataFrame:
    """a, b: pairs of nodes of different labels that share a shingle of their prefixes. known: node, size, prefix, code, label.

    A similar pair has at most |x| - o shingles before its first common one, o being the least overlap that its sizes allow;
    pairs are looked at where that holds. Of larger sets the first 256 bits of the fingerprints are compared, too: a pair
    further apart than five deviations from what the similarity makes likely is left out (one in three million that are just
    similar enough). Where most nodes of a group have one label, only the others are compared with all.
    """
    top, under = similarity.numerator, similarity.denominator
    share = np.arccos(2 * float(similarity) / (1 + float(similarity))) / np.pi
    far = int(256 * share + 5 * np.sqrt(256 * share * (1 - share)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            n = np.array([len(x) for x in raw], np.int64)
            sketch = np.frombuffer(b"".join([x.as_py()[:32].ljust(32) for x in b.column(4)]), np.int64).reshape(-1, 4)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.repeat(x, n) for x in (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(), *sketch.T)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([np.zeros(0, np.int64), *raw]), *columns, place)], names=["token", "node", "size", "label", "s", "t", "u", "v", "place"])

    rows = bounded_batches(known).select("node", "size", "prefix", "label", "code").mapInArrow(deal, "token long, node long, size long, label long, s long, t long, u long, v long, place long")
    rows = rows.repartition("token").sortWithinPartitions("token", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            token, node, size, label, *sketch, place = rows
            heads = np.flatnonzero(np.r_[True, np.diff(token) != 0])
            ends = np.r_[heads[1:], len(token)]
            mixed = np.minimum.reduceat(label, heads) != np.maximum.reduceat(label, heads)
            found, held = [np.zeros((2, 0), np.int64)], 0
            for i, j in zip(heads[mixed].tolist(), ends[mixed].tolist(), strict=True):
                values, of, n = np.unique(label[i:j], return_inverse=True, return_counts=True)
                some = i + np.flatnonzero(of != n.argmax())  # each pair of labels has one of these
                for k in range(0, len(some), block):
                    mine = some[k : k + block]
                    first = i + int(np.searchsorted(size[i:j] * under, size[mine[0]] * top, side="left"))  # sizes ascend
                    last = i + int(np.searchsorted(size[i:j] * top, size[mine[-1]] * under, side="right"))
                    for m in range(first, last, block):
                        other = slice(m, min(m + block, last))
                        least = -(-top * (size[mine, None] + size[None, other]) // (top + under))
                        ok = (label[mine, None] != label[None, other]) & (np.minimum((size - place)[mine, None], (size - place)[None, other]) >= least)
                        x, y = np.nonzero(ok)
                        x, y = mine[x], m + y
                        near = (np.minimum(size[x], size[y]) < 64) | (sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in sketch) <= far)
                        found.append(np.stack([node[x[near]], node[y[near]]]))
                        held += int(near.sum())
                        if held > 200_000:
                            yield pairs(found)
                            found, held = [np.zeros((2, 0), np.int64)], 0
            yield pairs(found)

        def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
            x = np.concatenate(found, axis=1)
            x = np.unique(np.stack([x.max(axis=0), x.min(axis=0)]), axis=1) if x.size else x
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])

        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            held.append(np.stack([c.to_numpy() for c in b.columns]))
            n += b.num_rows
            if n >= batch and held[0][0, 0] != held[-1][0, -1]:
                now = np.concatenate(held, axis=1)
                end = int(np.flatnonzero(now[0] != now[0, -1])[-1]) + 1  # the last group may go on
                yield from solve(now[:, :end])
                held, n = [now[:, end:]], now.shape[1] - end
        if n:
            yield from solve(np.concatenate(held, axis=1))
        hand_back()

    return rows.mapInArrow(run, "a long, b long").distinct()


def node_of(own: np.ndarray) -> int:
    """A signed long for a set of hashes (ascending)."""
    return int.from_bytes(hashlib.sha256(own.tobytes()).digest()[:8], "little", signed=True)


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, words: int = 8, batch: int = 20_000) -> DataFrame:
    """doc_id, component_id (the least doc_id reached over links) of every row of docs, linked where the sets of shingles
    are similar by at least the measure given.

    A wide fingerprint (words * 64 bits) tells the similarity of two texts from the share of bits that differ: s shared out
    of all shingles makes an angle of acos(2 s / (1 + s)), and that part of half a turn differs. Documents meet where they
    agree on a run of 16 bits (32 from a million texts on); in a group the same tree in Gray order compares them. A large
    group is cut into ranges of codes, over several tasks. Its pairs are candidates: only those whose sets of shingles are similar enough link. Pairs that the fingerprints miss are found by exact prefixes: of
    n shingles in one order for all, the first n - ceil(similarity n) + 1 of two similar sets have one in common. Only pairs
    that no link connects yet are looked at. Null and empty texts are alike. Texts with the same set are one node.
    """
    exact = Fraction(str(similarity))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    far = int(words * 64 * share + np.sqrt(words * 64 * share * (1 - share)))  # one deviation more, not to lose those at the limit

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                every = [np.unique(hashed(x, size)) for x in part.column(1).to_pylist()]  # sets: repeats have no vote
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([node_of(x) for x in every], pa.int64()),
                        pa.array([wide_fingerprint(x, words).astype(">u8").tobytes() for x in every], pa.binary()),
                        pa.array([len(x) for x in every], pa.int64()),
                        pa.array([prefix(x, common.value, exact).tobytes() for x in every], pa.binary()),
                    ],
                    names=["doc_id", "node", "code", "size", "prefix"],
                )
        hand_back()

    marks = written(bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(mark, "doc_id long, node long, code binary, size long, prefix binary"))
    codes = marks.groupBy("node").agg(F.min("doc_id").alias("least"))
    block = 16 if marks.count() < 1 << 20 else 32  # what meets here only saves work in candidates()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(0).to_pylist()
            values = np.frombuffer(b"".join(raw), ">u2" if block == 16 else ">u4").reshape(len(raw), -1).astype(np.int64)
            n = values.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(raw))), pa.array(values.ravel()), pa.array(np.repeat(b.column(1).to_numpy(), n)), pa.array([x for x in raw for _ in range(n)], pa.binary())], names=["part", "value", "node", "code"])

    groups = marks.select("code", "node").distinct().mapInArrow(deal, "part int, value long, node long, code binary").repartitionByRange("part", "value", "code").sortWithinPartitions("part", "value")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(key: np.ndarray, node: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
            rank = code.copy()
            for k in (1, 2, 4, 8, 16, 32):
                rank ^= rank >> np.uint64(k)
            order = np.lexsort((rank[:, 1] if words > 1 else rank[:, 0], rank[:, 0], key))
            key, node, code = key[order], node[order], code[order]
            tree = GrayTree(code, np.cumsum(np.r_[False, np.diff(key) != 0]))
            tree.links(far)
            a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in tree.used)]) for k in (0, 1))
            apart = np.bitwise_count(code[a] ^ code[b]).sum(axis=1, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.r_[node[a], node[b]], np.r_[node[b], node[a]], np.r_[apart, apart])], names=["a", "b", "apart"])

        held: list[tuple] = []
        rows = 0
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            held.append((key, b.column(2).to_numpy(), np.frombuffer(b"".join(b.column(3).to_pylist()), ">u8").reshape(b.num_rows, words).astype(np.uint64)))
            rows += b.num_rows
            if rows >= batch and held[0][0][0] != held[-1][0][-1]:
                key, node, code = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last group may go on
                yield solve(key[:end], node[:end], code[:end])
                held, rows = [(key[end:], node[end:], code[end:])], len(key) - end
        if rows:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))
        hand_back()

    nearest = groups.mapInArrow(link, "a long, b long, apart long").where("a <> b").groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("apart", "b"))), 1, 3).alias("near"))
    near = nearest.select("a", F.explode("near.b").alias("b"))  # a few for each node; candidates() has the rest
    first = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = alike(docs, codes, first, size, exact)
    sets = marks.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "prefix", "code"))).join(components(links), "node", "left").select("node", "size", "prefix", "code", F.coalesce("root", "node").alias("label"))
    links = links.unionByName(alike(docs, codes, candidates(sets, exact), size, exact))
    known = codes.join(components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return marks.join(named, "node").select("doc_id", "component_id")
