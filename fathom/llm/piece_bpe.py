"""Encoding and decoding with a SentencePiece BPE model by a prefix table.

For every prefix of a text the last token of its encoding is unique. The table holds it: an automaton over the
vocabulary finds the tokens that end at a position; the one that is compatible with the last token of the prefix before
it (the pair encodes to itself) is that prefix's last token. Ids are then recovered from the end backwards. A batch of
texts is reduced to its distinct words first; the table is made once for each.
Vocabularies are only read. Text is taken as it is (identity normalisation), with a space before it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import bounded_batches, chunks, distinct_words, hand_back, strung

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGEST_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PieceBpe:
    def __init__(self, model_file: str, cache_size: int = 60_000):
        sp = SentencePieceProcessor(model_file=model_file)
        self.pieces: dict[str, int] = {}
        self.score: dict[int, float] = {}
        self.texts: list[str] = []
        self.bytes_of: dict[int, int] = {}
        self.byte_ids = [0] * 256
        self.skipped = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.texts.append(piece)
            if sp.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
                self.byte_ids[int(piece[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.skipped.add(i)
            elif not sp.is_unused(i):
                self.pieces.setdefault(piece, i)
                self.score[i] = sp.get_score(i)
        if len(self.bytes_of) != 256 or any(SPACE in x.lstrip(SPACE) for x in self.pieces):
            raise ValueError("a BPE model with byte fallback and with spaces only at the start of pieces is asked for")
        order = sorted(self.score, key=lambda i: (-self.score[i], i))
        #: Earlier merges have smaller ranks. Runs of spaces have tied scores and are merged plainly (encode_chunk).
        self.rank = {i: k for k, i in enumerate(order)}
        if any(self.score[i] == self.score[j] and self.texts[i].strip(SPACE) for i, j in zip(order[1:], order, strict=False)):
            raise ValueError("pieces with equal scores, other than runs of spaces, leave the last token open")
        self.chars = {x for x in self.pieces if len(x) == 1}
        #: The two tokens that a token is merged from at last; a single character has none.
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            whole = self.merge(piece)
            if whole == [i]:  # a piece that no merging reaches never ends a prefix
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        if any("\n" in x and len(x) > 1 for x in self.pieces):
            raise ValueError("a model whose pieces do not reach over line ends is asked for")
        self.digits = [b"%d," % i for i in range(len(self.texts))]
        self.shown = [None if i in self.skipped or i in self.bytes_of else x.replace(SPACE, " ") for i, x in enumerate(self.texts)]
        self.pairs: dict[int, bool] = {}
        self.id_bits = len(self.texts).bit_length()
        self.pair_limit = 500_000
        self.cache_size = cache_size
        #: Two generations of words: their ids as decimal numbers, each with a comma, and their text; a full one replaces the older.
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of a text by merging its best pair again and again, leftmost first; the base that the table rests on."""
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (i := self.pieces.get(joined := part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, joined))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != joined:
                continue
            if joined == text:
                self.split[self.pieces[joined]] = self.pieces[part[a]], self.pieces[part[b]]
            part[a], part[b] = joined, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for x in part:
            if x is not None:
                i = self.pieces.get(x)
                out += [i] if i is not None else [self.byte_ids[y] for y in x.encode("utf-8", "surrogatepass")]
        return out

    def compatible(self, first: int, second: int) -> bool:
        """Whether the texts of the two, put together, encode to just these two.

        Goes back in time: of the two tokens at the seam the later made is taken apart, and at no step may the pair at the
        seam have a merge of its own that comes before the earliest step undone so far.
        """
        rank, split, texts = self.rank, self.split, self.texts
        a, b = first, second
        undone = len(rank) + 1
        while True:
            joined = self.pieces.get(texts[a] + texts[b])
            if joined is not None and rank[joined] < undone:
                return False
            left, right = split.get(a), split.get(b)
            if left is None and right is None:
                return True
            if right is None or (left is not None and rank[a] > rank[b]):
                undone, a = rank[a], left[1]
            else:
                undone, b = rank[b] + 1, right[0]  # of equal merges the left one comes first

    def encode_chunk(self, text: str) -> list[int]:
        """A chunk is a run of spaces with the word after it; no piece reaches over its ends."""
        if text.startswith(SPACE * 2):
            return self.merge(text)  # runs of spaces have tied scores
        n = len(text)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        pairs, chars, bits = self.pairs, self.chars, self.id_bits
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] != -1:
                continue
            at = end - size
            if at:
                prior = last[at]
                if prior == -1:
                    if text[at - 1] in chars:
                        continue  # what is outside the vocabulary merges with nothing
                else:
                    key = prior << bits | token
                    try:
                        if not pairs[key]:
                            continue
                    except KeyError:
                        if len(pairs) >= self.pair_limit:
                            pairs.clear()
                        ok = pairs[key] = self.compatible(prior, token)
                        if not ok:
                            continue
            last[end], start[end] = token, at
        out: list[int] = []
        end = n
        while end:
            token = last[end]
            if token == -1:
                out += [self.byte_ids[y] for y in reversed(text[end - 1].encode("utf-8", "surrogatepass"))]
                end -= 1
            else:
                out.append(token)
                end = start[end]
        return out[::-1]

    def known(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as decimal numbers, each with a comma; the text that they stand for) of each chunk.

        A chunk's bytes form whole characters, so chunks decode one by one.
        """
        got = list(map(self.cache.get, chunks))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    chunk = chunks[k]
                    if (x := self.older.get(chunk)) is None:
                        ids = self.encode_chunk(chunk)
                        x = b"".join([self.digits[i] for i in ids]), self._text(ids).encode()
                    got[k] = x
                    if len(chunk) < 64:
                        self.cache[chunk] = x
            if len(self.cache) > self.cache_size:
                self.cache, self.older = {}, self.cache
        return got

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text:
            return CHUNK.findall(SPACE + text.replace(" ", SPACE))
        return [x if x[:1] == "\n" else SPACE + x for x in text.replace("\n", " \n").split(" ")]

    def encode(self, text: str) -> list[int]:
        return [int(x) for part, _ in self.known(self.chunks(text)) for x in part[:-1].split(b",")]

    def encode_decode_batch(self, texts: pa.Array) -> tuple[list[bytes | memoryview], list[bytes | memoryview]]:
        """Of each text the ids as decimal numbers, each with a comma, and the text that they decode to. No nulls."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, SPACE), pc.equal(texts, "")))
        words, index, edges = distinct_words(texts.filter(pc.invert(odd)))
        values = self.known([w if w[:1] == "\n" else SPACE + w for w in words])
        digits, shown = (iter(strung([v[k] for v in values], index, edges)) for k in (0, 1))
        out: tuple[list, list] = ([], [])
        for k, alone in enumerate(odd.to_pylist()):
            if alone:
                parts = self.known(self.chunks(texts[k].as_py()))
                a, b = (b"".join([x[n] for x in parts]) for n in (0, 1))
            else:
                a, b = next(digits), next(shown)
            out[0].append(a)
            out[1].append(b[1:] if b[:1] == b" " else b)
        return out

    def _text(self, ids: list[int]) -> str:
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:  # there are ids without a text of their own
            pass
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            if i != -1 and i not in self.skipped:
                out.append(self.texts[i].replace(SPACE, " "))
            elif i in self.skipped and self.texts[i] == "<unk>":
                out.append(" ⁇ ")
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._text(ids)
        return text[1:] if text.startswith(" ") and ids and self.texts[ids[0]].startswith(SPACE) else text


def _utf8(raw: bytes) -> str:
    """Bytes that are not UTF-8 become one replacement character each."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


_LOADED: dict[str, PieceBpe] = {}


def loaded(model_file: str) -> PieceBpe:
    """One table for a worker process, until its task ends."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceBpe(model_file)
    return _LOADED[model_file]


def encode_decode(docs: DataFrame, model_file: str, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string), a row for each row of docs; digest=True: their count and hashes.

    Null texts count as empty; empty texts have no ids and decode to an empty text. Ids may be null or repeated; other
    columns are not read. No shuffle; the memory is bounded by a batch of rows and the caches of words.
    """
    schema = DIGEST_SCHEMA if digest else OUT_SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(model_file)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in chunks(batches, 2 << 20):
            texts = part["text"].combine_chunks()
            digits, shown = table.encode_decode_batch(pc.fill_null(texts, ""))
            if digest:
                columns = [pa.array([bytes(x).count(b",") for x in digits], pa.int64()), pa.array([sha(x[:-1]) for x in digits]), pa.array([sha(x) for x in shown])]
            else:
                ids = [np.array(bytes(x[:-1]).split(b",") if len(x) else [], np.int32) for x in digits]
                columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([str(x, "utf-8") for x in shown], pa.string())]
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().cast(pa.int64()), *columns], schema=schema)
        _LOADED.clear()  # the worker lives on for other work; a table is read again in a third of a second
        del table
        hand_back()

    out = "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return bounded_batches(docs).select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, out)
