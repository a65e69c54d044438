"""Document fingerprints by I-Match: hashes of the sorted distinct terms that lie in a band of document frequency.

The lexicon has the terms that at least one document in `rare` and at most one in `common` holds. One signature hashes all
of a text's terms in the lexicon; the others hash those in randomised subsets of it, which keep a quarter to a 1024th of the
terms, so that texts of any length have subsets with few of their terms. Two texts are alike by the share of equal
signatures among the subsets in which either has terms; a subset that keeps one term in n counts n times. Where it holds
one term of the two texts, it is equal as often as a term is common to both, so the share nears the common part of the terms.

Document frequencies are summed in Spark from counts of chunks. Texts are sorted by id in ranges, so that each row meets the
next one; the rows at the ends of ranges are put together afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, chunks, hand_back, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Subsets keep 2^-b of the terms; so many for each b.
LEVELS = {2: 4, 4: 8, 6: 16, 8: 16, 10: 20}
BITS = [b for b, n in LEVELS.items() for _ in range(n)]
WEIGHTS = [1, *(1 << b for b in BITS)]
FACTORS = [int(hashlib.md5(f"subset {j}".encode()).hexdigest()[:15], 16) | 1 for j in range(len(BITS))]
RARE, COMMON = 2000, 10
MOST_TERMS = 2_000_000
CHUNK_BYTES = 4 << 20
#: A task hands on its counts when it has so many terms.
COUNTED = 500_000

DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def terms(text: bytes) -> set[bytes]:
    """Distinct words of a text, A-Z lower-cased."""
    return set(WORD.findall(text.translate(ASCII_LOWER)))


def hashes(words: list[bytes]) -> np.ndarray:
    """The second half of each word's MD5."""
    return np.frombuffer(b"".join([hashlib.md5(w).digest()[8:] for w in words]), "<u8")


def likeness(a: str, b: str) -> float:
    """The share of equal signatures among those that either has, by weight."""
    both = [(w, x == y) for w, x, y in zip(WEIGHTS, a.split(","), b.split(","), strict=True) if x or y]
    return sum(w for w, equal in both if equal) / sum(w for w, _ in both)


def sign(texts: list[bytes], kept: Callable[[list[bytes], np.ndarray], np.ndarray]) -> list[str]:
    """The fingerprint of each text: the signature of all its terms, then those of the subsets, empty where it has none.

    kept tells which of some terms (and their hashes) are in the lexicon. A text without a term in it is signed by all its
    terms, and one without any terms by its bytes.
    """
    sets = [terms(t) for t in texts]
    words = list(set().union(*sets))
    place = dict(zip(words, range(len(words)), strict=True))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    word = np.array([place[w] for s in sets for w in s], np.int64)
    text = np.repeat(np.arange(len(sets)), sizes)
    h = hashes(words)
    held = kept(words, h)[word] if words else np.zeros(0, bool)
    held |= np.bincount(text[held], minlength=len(sets))[text] == 0
    word, text = word[held], text[held]
    used = np.array(sorted(np.unique(word).tolist(), key=words.__getitem__), np.int64)  # only these are sorted and dealt to subsets
    names, h = [words[k] for k in used.tolist()], h[used]
    rank = np.zeros(len(words), np.int64)
    rank[used] = np.arange(len(used))
    order = np.lexsort((rank[word], text))
    word, text = rank[word][order], text[order]
    inside = np.ascontiguousarray(np.stack([np.ones(len(h), bool), *(h * np.uint64(f) >> np.uint64(64 - b) == 0 for f, b in zip(FACTORS, BITS, strict=True))]).T)
    out = []
    ends = np.searchsorted(text, np.arange(len(sets) + 1)).tolist()
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a == b:
            out.append(hashlib.md5(texts[k]).hexdigest()[:16] + "," * len(BITS))
            continue
        own = word[a:b]
        subset, at = np.nonzero(inside[own].T)
        mine = [names[i] for i in own[at].tolist()]
        cuts = np.searchsorted(subset, np.arange(len(BITS) + 2)).tolist()
        out.append(",".join([hashlib.md5(b" ".join(mine[: cuts[1]])).hexdigest()[:16], *[hashlib.md5(b" ".join(mine[x:y])).hexdigest()[:6] if y > x else "" for x, y in zip(cuts[1:-1], cuts[2:], strict=True)]]))
    return out


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """h: hashes of the terms that at least one row of docs in `rare` and at most one in `common` holds; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes(list(seen)).view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])

        for part in chunks(batches, CHUNK_BYTES):
            for t in part["text"].to_pylist():
                if t:
                    seen.update(terms(t))
            if len(seen) > COUNTED:
                yield counted()
                seen.clear()
        yield counted()
        hand_back()

    rows = docs.count()
    found = bounded_batches(docs).select(F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return written(found.where((F.col("n") * rare >= rows) & (F.col("n") * common <= rows)).select("h"))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """(doc_id, text) in chunks of bounded size; the last row of a chunk is the first of the next one. True: the last chunk."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for batch in batches:
        for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            held.append((d, t or ""))
            size += len(t or "")
            if size >= CHUNK_BYTES and len(held) > 1:
                yield held, False
                held, size = held[-1:], len(held[-1][1])
    if held:
        yield held, True


def _rows(held: list[tuple[int | None, str]], kept: Callable[[list[bytes], np.ndarray], np.ndarray]) -> list[tuple]:
    """Rows of DIGEST for all of held but the last, which is only the next of the one before."""
    changed = [edited(t, held[k + 1][1]).encode() for k, (_, t) in enumerate(held[:-1])]
    prints = sign([t.encode() for _, t in held] + changed, kept)
    own, new = prints[: len(held)], prints[len(held) :]
    return [(d, len(t), hashlib.sha256(x).hexdigest(), p, q, likeness(p, q), likeness(p, following)) for (d, t), x, p, q, following in zip(held[:-1], changed, own[:-1], new, own[1:], strict=True)]


ENDS = ", part long, first boolean, text string"


def _paired(docs: DataFrame, kept: Callable[[list[bytes], np.ndarray], np.ndarray] | None) -> DataFrame:
    """Rows of DIGEST and, with part set, the first and the last row of each range. kept None: texts in place of digests."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.string()]
    schema = DIGEST + ENDS if kept else "doc_id long, text string, following string, part long, first boolean"
    types = types if kept else [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        for held, last in _with_next(batches):
            out = [(*x, None, None, None) for x in _rows(held, kept)] if kept else [(d, t, held[k + 1][1], None, None) for k, (d, t) in enumerate(held[:-1])]
            ends = [(held[0], True)] * first + [(held[-1], False)] * last
            out += [(d, *[None] * 6, part, is_first, t) if kept else (d, t, None, part, is_first) for (d, t), is_first in ends]
            first = False
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
        hand_back()

    start = F.substring(F.coalesce("text", F.lit("")), 1, 32)  # equal ids are ordered by text
    laid = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return laid.repartitionByRange("doc_id", start).sortWithinPartitions("doc_id", "text").mapInArrow(run, schema)


def _joined_ends(ends: DataFrame) -> DataFrame:
    """doc_id, text, following of the last row of each range: at most as many rows as there are ranges, put in order in one task."""
    order = Window.orderBy("part", F.desc("first"))
    whole = Window.partitionBy().orderBy("part", F.desc("first")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead("text").over(order), F.first("text").over(whole))
    return ends.select("doc_id", "text", "first", following.alias("following")).where(~F.col("first")).drop("first")


def fingerprints(docs: DataFrame, rare: int = RARE, common: int = COMMON, most_terms: int = MOST_TERMS) -> DataFrame:
    """A row of DIGEST for each row of docs (doc_id, text).

    fingerprint is the text's, edited_fingerprint that of the text whose last half is replaced by the beginning of the next
    row's (by doc_id, nulls first, equal ids by text; after the last comes the first); near_edited and near_next are the
    likenesses of fingerprint to the edited text's and to the next row's. Null texts are empty. Empty texts and those without
    words are alike only if equal. A table of one row is its own next. Other columns are not read; no rows give no rows.

    The lexicon has at most `rare` times as many terms as a document has on average. Up to most_terms of them (16 MB) it goes
    to every task; a larger one is joined with the terms of the texts instead, with the same results.
    """
    spark = docs.sparkSession
    known = lexicon(docs, rare, common)
    if known.count() > most_terms:
        return _by_join(docs, known)
    sent = spark.sparkContext.broadcast(np.sort(np.array(known.toArrow()["h"].to_numpy()).view(np.uint64)))

    def kept(words: list[bytes], h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sent.value, h)
        return sent.value[np.minimum(at, len(sent.value) - 1)] == h if len(sent.value) else np.zeros(len(h), bool)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_rows([(d, t), (None, f)], kept)[0] for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()])], names=[x.split()[0] for x in DIGEST.split(", ")])

    done = written(_paired(docs, kept), "zstd")
    columns = [x.split()[0] for x in DIGEST.split(", ")]
    last = _joined_ends(done.where(F.col("part").isNotNull()).select("doc_id", "text", "part", "first"))
    return done.where(F.col("part").isNull()).select(columns).unionByName(last.mapInArrow(signed, DIGEST))


def _by_join(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The same for a lexicon of any size: the terms of the texts meet it in a join."""
    done = written(_paired(docs, None), "zstd")
    last = _joined_ends(done.where(F.col("part").isNotNull()).select("doc_id", "text", "part", "first"))
    pairs = written(done.where(F.col("part").isNull()).select("doc_id", "text", "following").unionByName(last).withColumn("row", F.expr("uuid()")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for side, x in enumerate((text, edited(text, following), following)):
                    words = sorted(terms(x.encode()))
                    out.append((row, side, [w.decode("utf-8", "replace") for w in words], hashes(words).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=["row", "side", "words", "h"])

    words = pairs.select("row", "text", "following").mapInArrow(split, "row string, side int, words array<string>, h array<long>")
    each = words.select("row", "side", F.explode(F.arrays_zip("words", "h")).alias("x")).select("row", "side", F.col("x.words").alias("word"), F.col("x.h").alias("h"))
    held = each.join(known.withColumn("known", F.lit(True)), "h", "left").groupBy("row").agg(F.collect_list(F.when(F.col("known"), F.struct("side", "word"))).alias("known"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, text, following, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                changed = edited(text, following).encode()
                prints = []
                for side, x in enumerate((text.encode(), changed, following.encode())):
                    mine = {w["word"].encode() for w in found or () if w["side"] == side}
                    prints += sign([x], lambda ws, _, mine=mine: np.array([w in mine for w in ws], bool))
                rows.append((d, len(text), hashlib.sha256(changed).hexdigest(), prints[0], prints[1], likeness(prints[0], prints[1]), likeness(prints[0], prints[2])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()])], names=[x.split()[0] for x in DIGEST.split(", ")])

    return pairs.join(held, "row", "left").select("doc_id", "text", "following", "known").mapInArrow(signed, DIGEST)
