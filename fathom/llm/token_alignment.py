"""Cross-tokenizer alignment: how the tokens of two tokenizers overlap in each text, and how often pairs of ids do so.

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with byte fallback. Both cut a text before a space
or a line end that stands between two characters that are not white space, so a text is a run of units, and a unit is
aligned once for each distinct one of a batch. The units are laid end to end on one axis of bytes; DuckDB holds the two
tables of token intervals in memory, finds links by ASOF joins with a range condition (the B token under the start of each A
token, and those that begin within it), and groups by window sums over the ends that both tables have.

Counts of pairs cover the corpus, so there are two passes. The first writes, for each chunk of rows, the pairs of ids in it
with their counts, and for each row the places of its pairs; a pair is sent once for each chunk, however often it occurs.
Spark sums the counts; the sums go back to the chunks that hold the pair, where rows are summed up.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .common import bounded_batches, chunks, distinct_words, hand_back, strung, written
from .token_files import byte_symbols

CHUNK_BYTES = 4 << 20
#: Units, or links of rows, that a chunk works on at once: several workers share an executor's memory.
SLICE = 1 << 15
#: A cut that both tokenizers make: before a space or a line end between two characters that are not white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
PLAIN = re.compile(r"[ \n]?\S+")
#: White space but the space and the line end.
_OTHER = r"\t\x{0b}-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts in which white space stands otherwise than at cuts (for Arrow's patterns).
ODD = rf"[ \n]{{2}}|[{_OTHER}]|\A[ \n]|[ \n]\z"

#: A token of A and a token of B overlap if A's begins within B's (the last that begins before), or B's within A's.
LINKS = """
SELECT a.k, a.id << 32 | b.id AS pair FROM a ASOF JOIN b ON a.s >= b.s
UNION ALL SELECT a.k, a.id << 32 | b.id FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e
"""
#: A token's group is the number of common ends before its own; A's tokens of a group come before B's.
GROUPS = """
WITH common AS (SELECT e FROM a SEMI JOIN b USING (e)), t AS (SELECT 0 AS side, k, id, e FROM a UNION ALL SELECT 1, k, id, e FROM b)
SELECT side, id, coalesce(sum(CAST(common.e IS NOT NULL AS INT)) OVER (PARTITION BY side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
FROM t LEFT JOIN common USING (e) ORDER BY g, side, k
"""

#: What a chunk of rows is written as.
CHUNK = "chunk long, pairs array<long>, n array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, ends array<long>, at array<int>, times array<int>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Values in a row, and where each begins (and the end)."""
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate(([0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))))


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run; many: their lengths."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Vocabulary:
    """The bytes of a tokenizer's ids."""

    def __init__(self, values: list[bytes]):
        self.data, self.starts = _flat(values)
        self.lengths = np.diff(self.starts)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.data[_runs(self.starts[ids], self.lengths[ids])].tobytes()


class Aligner:
    """Aligns texts; holds the two vocabularies and nothing of the texts."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True  # their strings are plain text
        with open(byte_file, encoding="utf-8") as f:
            told = json.load(f)
        pre = told["pre_tokenizer"]
        if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE without normaliser and prefix space is asked for")
        symbols = byte_symbols()
        a_bytes = [b""] * (1 + max(told["model"]["vocab"].values()))
        for x, i in told["model"]["vocab"].items():
            if all(c in symbols for c in x):
                a_bytes[i] = bytes(symbols[c] for c in x)
        self.b = SentencePieceProcessor(model_file=piece_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces that go on over a space or hold a line end: texts can't be cut there")
        self.a_bytes = Vocabulary(a_bytes)
        self.b_bytes = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        digits = [str(i).encode() for i in range(max(len(a_bytes), len(pieces)))]
        self.shown = Vocabulary([x + sep for sep in (b",", b"|", b";") for x in digits])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and of B for a text that begins with its space (or a line end); None if one does not keep its bytes."""
        raw = text.encode()
        ids_a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        # the library sets a space before what it gets; before a line end that space is a piece of its own
        ids_b = np.array(self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:], np.int64)
        return (ids_a, ids_b) if self.a_bytes.joined(ids_a) == raw == self.b_bytes.joined(ids_b) else None

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of units in a row, the numbers of both in each unit, and which units have tokens."""
        parts: list[tuple[int, int, str]] = []  # units that may stand in one text, so that the libraries are called less often
        first = 0
        for k in range(1, len(units) + 1):
            if k == len(units) or k - first == 4096 or not (PLAIN.fullmatch(units[k - 1]) and PLAIN.fullmatch(units[k])):
                parts.append((first, k, "".join(units[first:k])))
                first = k
        ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        counts = np.zeros((2, len(units)), np.int64)
        for first, last, text in parts:
            todo = [(first, last, text)]
            while todo:
                a, b, text = todo.pop()
                got = self._encoded(text)
                if got is None:
                    if b - a > 1:
                        todo += [(k, k + 1, units[k]) for k in range(b - 1, a - 1, -1)]
                    continue
                ends = np.cumsum(np.fromiter((len(u.encode()) for u in units[a:b]), np.int64, b - a))
                cuts = [np.searchsorted(np.cumsum(known.lengths[x]), ends) + 1 for x, known in zip(got, (self.a_bytes, self.b_bytes), strict=True)]
                for side in (0, 1):
                    ids[side].append(got[side])
                    counts[side, a:b] = np.diff(cuts[side], prepend=0)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ids]
        return flat[0], flat[1], counts[0], counts[1], counts[0] > 0

    def aligned(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Links (place of the A token, pair of ids), and the tokens in order of groups (side, id, g)."""
        for name, ids, known in (("a", ids_a, self.a_bytes), ("b", ids_b, self.b_bytes)):
            e = np.cumsum(known.lengths[ids])
            self.db.register(name, pa.table({"k": np.arange(len(ids)), "id": ids, "s": e - known.lengths[ids], "e": e}))
        links, groups = self.db.sql(LINKS).to_arrow_table(), self.db.sql(GROUPS).to_arrow_table()
        self.db.unregister("a")
        self.db.unregister("b")
        return links["k"].to_numpy(), links["pair"].to_numpy(), groups

    def _placed(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the place among them of each unit of the texts in a row, and the row that each belongs to."""
        texts = pc.if_else(pc.match_substring(texts, "▁"), "", pc.fill_null(texts, ""))  # B takes that sign for a space
        full, odd = pc.not_equal(texts, ""), pc.match_substring_regex(texts, ODD)
        words, index, edges = distinct_words(texts.filter(pc.and_not(full, odd)))
        units = [w if w[0] == "\n" else " " + w for w in words]
        row = np.repeat(np.flatnonzero(pc.and_not(full, odd).to_numpy(zero_copy_only=False)), np.diff(edges))
        more, rows = dict(zip(units, range(len(units)), strict=True)), [row]
        at = [index.astype(np.int64)]
        for k in np.flatnonzero(pc.and_(full, odd).to_numpy(zero_copy_only=False)).tolist():
            at.append(np.array([more.setdefault(u, len(more)) for u in CUT.split(" " + texts[k].as_py())], np.int64))
            rows.append(np.full(len(at[-1]), k))
        return list(more), np.concatenate(at), np.concatenate(rows)

    def _units(self, units: list[str]) -> tuple[list[np.ndarray], np.ndarray, pa.LargeBinaryArray]:
        """For units: how many tokens of A and of B, groups and links each has (and whether it has any token), the pairs of ids
        of its links, a unit's after the other's, and its groups as text."""
        ids_a, ids_b, n_a, n_b, kept = self.encoded(units)
        link_a, pair, groups = self.aligned(ids_a, ids_b)
        ends_a = np.cumsum(n_a)  # a unit's end is common, so neither links nor groups go over it
        unit_of = np.repeat(np.arange(len(units)), n_a)[link_a]
        side, g = groups["side"].to_numpy(), groups["g"].to_numpy().astype(np.int64)
        last = np.append((side[1:] != side[:-1]) | (g[1:] != g[:-1]), True)
        sign = groups["id"].to_numpy() + len(self.shown.lengths) // 3 * np.where(last, 1 + side, 0)  # 1: the bar, 2: the semicolon
        data = self.shown.data[_runs(self.shown.starts[sign], self.shown.lengths[sign])]
        sizes = np.concatenate(([0], np.cumsum(self.shown.lengths[sign])))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        g_of_a = g[side == 0]
        n_groups = np.diff(np.where(ends_a > 0, g_of_a[np.maximum(ends_a, 1) - 1] + 1, 0) if len(g_of_a) else ends_a, prepend=0)
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(sizes.astype("<i8")), pa.py_buffer(data)])
        counts = [n_a, n_b, n_groups, np.bincount(unit_of, minlength=len(units)), kept]
        return counts, pair[np.argsort(unit_of, kind="stable")], strings

    def chunk(self, doc_ids: pa.Array, texts: pa.Array, most: int = SLICE) -> dict:
        """The columns of CHUNK for some rows. Units, then rows, are worked on in slices, `most` units or links at a time."""
        n_rows = len(texts)
        units, at_unit, doc = self._placed(texts)
        slices = [self._units(units[k : k + most]) for k in range(0, max(1, len(units)), most)]
        n_a, n_b, n_groups, n_links, kept = (np.concatenate(x) for x in zip(*(counts for counts, _, _ in slices), strict=True))
        pairs, of_link = np.unique(np.concatenate([pair for _, pair, _ in slices]), return_inverse=True)
        of_link, strings = of_link.astype(np.int32), pa.chunked_array([x for _, _, x in slices]).combine_chunks()
        n_units = max(1, len(units))
        del slices, units
        lost = np.zeros(n_rows, bool)
        lost[doc[~kept[at_unit]]] = True
        at_unit, doc = at_unit[~lost[doc]], doc[~lost[doc]]
        order = np.argsort(doc, kind="stable")
        at_unit, doc = at_unit[order], doc[order]

        total = lambda values: np.bincount(doc, weights=values[at_unit], minlength=n_rows).astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_rows))))
        first_link, linked = np.cumsum(n_links) - n_links, np.cumsum(total(n_links))
        n, shas, row_of, at, times = np.zeros(len(pairs), np.int64), [], [], [], []
        a = 0
        while a < n_rows:  # rows a to b: as many as have `most` links, or one
            b = max(a + 1, int(np.searchsorted(linked, (linked[a - 1] if a else 0) + most, "right")))
            x, y = at_unit[cuts[a] : cuts[b]], doc[cuts[a] : cuts[b]]
            shas += [hashlib.sha256(s[:-1]).hexdigest() if len(s) else "" for s in strung(strings, x, cuts[a : b + 1] - cuts[a])]
            # (row, unit) with its number of occurrences, then (row, pair) with its number of links
            both, each = np.unique(y * n_units + x, return_counts=True)
            unit = both % n_units
            many = n_links[unit]
            where = np.repeat(both // n_units, many) * max(1, len(pairs)) + of_link[_runs(first_link[unit], many)]
            seen, back = np.unique(where, return_inverse=True)
            each = np.bincount(back, weights=np.repeat(each, many), minlength=len(seen)).astype(np.int64)
            place = seen % max(1, len(pairs))
            n += np.bincount(place, weights=each, minlength=len(pairs)).astype(np.int64)
            row_of.append(np.bincount(seen // max(1, len(pairs)) - a, minlength=b - a))
            at.append(place.astype(np.int32))
            times.append(each.astype(np.int32))
            a = b
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {
            "pairs": pairs, "n": n, "doc_id": doc_ids, "n_a": total(n_a), "n_b": total(n_b), "n_groups": total(n_groups),
            "n_links": total(n_links), "groups_sha256": shas, "ends": np.cumsum(flat(row_of, np.int64)), "at": flat(at, np.int32), "times": flat(times, np.int32),
        }


_LOADED: dict[tuple[str, str], Aligner] = {}


def loaded(byte_file: str, piece_file: str) -> Aligner:
    """One aligner for a worker process, until its task ends."""
    if (byte_file, piece_file) not in _LOADED:
        _LOADED[byte_file, piece_file] = Aligner(byte_file, piece_file)
        gc.freeze()
    return _LOADED[byte_file, piece_file]


def chunked(docs: DataFrame, byte_file: str, piece_file: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The first pass: a row of CHUNK for each chunk of rows (chunk_bytes of text, or one longer row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = loaded(byte_file, piece_file), TaskContext.get().partitionId()
        for k, part in enumerate(chunks(batches, chunk_bytes)):
            got = aligner.chunk(part["doc_id"].combine_chunks(), part["text"].combine_chunks())
            columns = [pa.array([task << 32 | k], pa.int64())]
            for name, x in got.items():
                flat = x if isinstance(x, pa.Array) else pa.array(x, pa.string() if name == "groups_sha256" else None)
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", *got])
            del got, columns, flat
            hand_back()
        _LOADED.clear()
        del aligner
        hand_back()

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK)


def pair_counts(chunk_rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it), best (no pair with its B id has more). pair is the A id * 2^32 + the B id."""
    pairs = chunk_rows.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n").alias("n"))
    # over the rows of one B id: as many as there are A ids, at most
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))))


def align(docs: DataFrame, byte_file: str, piece_file: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of docs.

    Texts that are null or empty, and those whose bytes a tokenizer does not keep (A's or B's joined tokens are not
    space+text), have zeros and an empty groups_sha256. Ids may be null or repeated; other columns are not read. A text of any
    length is taken whole; one longer than chunk_bytes is a chunk of its own. Without rows there are no rows.
    """
    rows = written(chunked(docs, byte_file, piece_file, chunk_bytes), group_rows=1)  # a task holds one chunk, however many its split has
    counts = pair_counts(rows)
    back = rows.select("chunk", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        x = {name: left[name].combine_chunks().flatten() for name in left.column_names if name != "chunk"}
        order = np.argsort(right["place"].to_numpy())
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order]
        at, times = x["at"].to_numpy(), x["times"].to_numpy().astype(np.int64)
        ends = x["ends"].to_numpy()
        upto = lambda v: np.concatenate(([0], np.cumsum(v)))
        sums = [np.diff(np.concatenate(([0], upto(v)[ends]))) for v in (times * best[at], times * n[at])] if len(n) else [np.zeros(len(ends), np.int64)] * 2
        return pa.table([x["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], pa.array(sums[0]), pa.array(sums[1]), x["groups_sha256"]], names=[c.split()[0] for c in OUT.split(", ")])

    return rows.drop("pairs", "n").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(summed, OUT)
