"""Token-id files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is a run of zstandard frames; each holds the ids (little-endian unsigned 32-bit) of some whole documents. Then
come two skippable frames, which plain zstandard readers pass over: an index of the documents (id, number of ids), and
the seek table of the public seekable format (compressed size, size, lower half of the XXH64 of the content; footer).
A reader finds a document by the index and decompresses its frame only.
"""

from __future__ import annotations

import gc
import io
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import as_list, bounded_batches, chunks, coded_words, shared_folder, strung, written

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
FRAME_BYTES = 1 << 18

#: White space as Unicode and the tokenizers library define it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: Runs of white space in which a space or a line end is no cut of the byte-level pattern.
RUN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RUNS = rf"{RUN}{{3}}|{RUN}{{2}}\z"
#: Signs at the end of a word are cut off by the pattern if a letter or digit (these are ones by any version of Unicode) is before them.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEFORE_SIGNS = r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]\z"


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE of the tokenizers library, with a cache of words.

    Outside longer runs of white space the byte-level pattern cuts before each space and each line end, so the ids of what
    lies between do not depend on the surroundings. A batch of texts is reduced to its distinct words; new ones go to the library many at a time, as one text, and the ids
    are dealt back by the number of bytes that each stands for. Signs at the end of a word are encoded apart from it, so words
    that differ in these only are one. The cache has two generations; a full one replaces the
    older, so frequent words stay.
    """

    def __init__(self, file: str, cache_size: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        pre = told["pre_tokenizer"]
        if told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE without normaliser and prefix space is asked for")
        symbols, self.special = byte_symbols(), [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of text that an id stands for; 0 where that is not known.
        self.bytes_of = np.zeros(1 + max(told["model"]["vocab"].values()), np.int64)
        for x, i in told["model"]["vocab"].items():
            self.bytes_of[i] = len(x) if all(c in symbols for c in x) else 0
        self.cache_size = cache_size
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with the space or line end before it, encoded as one text."""
        text = "".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.cumsum(np.fromiter(map(len, words if text.isascii() else [w.encode() for w in words]), np.int64, len(words)))
        done = np.cumsum(self.bytes_of[ids])
        at = np.searchsorted(done, ends)
        if done[-1] != ends[-1] or (done[at] != ends).any():
            return self._plain(words)
        raw, cuts = ids.astype("<u4").tobytes(), [0, *((at + 1) * 4).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of each of some distinct words, with a space before it unless it begins with a line end."""
        got = list(map(self.cache.get, words))
        new, alone = [], []
        for k in [k for k, x in enumerate(got) if x is None]:
            w = words[k]
            if (x := self.older.get(w)) is not None:
                got[k] = self.cache[w] = x
            else:
                (new if w.isprintable() and w and len(w) < 256 else alone).append(k)
        for a in range(0, len(new), 4096):
            part = new[a : a + 4096]
            for k, x in zip(part, self._together([" " + words[k] for k in part]), strict=True):
                got[k] = x
                if len(words[k]) < 64:
                    self.cache[words[k]] = x
        for k, x in zip(alone, self._plain([words[k] if words[k][:1] == "\n" else " " + words[k] for k in alone]), strict=True):
            got[k] = x
            if len(words[k]) < 64:
                self.cache[words[k]] = x
        if len(self.cache) > self.cache_size:
            self.cache, self.older = {}, self.cache
        return got

    def known_coded(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """What known() gives; it gets the words without the signs at their ends."""
        bare = pc.ascii_rtrim(words, SIGNS)
        bare = pc.if_else(pc.match_substring_regex(bare, BEFORE_SIGNS), bare, words)
        stems, ends = bare.dictionary_encode(), tails(words, bare).dictionary_encode()
        signs = as_list(ends.dictionary)
        if len(self.signs) > self.cache_size:
            self.signs = {}
        new = [x for x in signs if x not in self.signs]
        self.signs |= zip(new, self._plain(new), strict=True)
        first = pa.array(self.known(as_list(stems.dictionary)), pa.large_binary()).take(stems.indices)
        second = pa.array([self.signs[x] for x in signs], pa.large_binary()).take(ends.indices)
        return pc.binary_join_element_wise(first, second, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [bytes(x) for x in self.encode_batch(pa.array(texts, pa.string()))]

    def encode_batch(self, texts: pa.Array) -> list[bytes | memoryview]:
        """Ids of each text; no nulls."""
        odd = pc.match_substring_regex(texts, RUNS)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        words, index, edges = coded_words(texts.filter(pc.invert(odd)))
        starts = edges[:-1]  # a text's first word has no space before it
        first = self._plain(as_list(words.take(pa.array(index[starts]))))
        index = index.copy()
        index[starts] = len(words) + np.arange(len(starts))
        ids = iter(strung(pa.concat_arrays([self.known_coded(words), pa.array(first, pa.large_binary())]), index, edges))
        return [self._alone(texts[k].as_py()) if x else next(ids) for k, x in enumerate(odd.to_pylist())]

    def _alone(self, text: str) -> bytes:
        """Ids of a text with runs of white space or special strings."""
        if any(x in text for x in self.special):
            return self._plain([text])[0]
        chunks = CHUNK.findall(text)
        words = list({x[1:] for x in chunks if x[0] == " " and len(x) > 1 and not x[1].isspace()})
        known = {" " + w: x for w, x in zip(words, self.known(words), strict=True)}
        rest = list({x for x in chunks if x not in known})
        known |= zip(rest, self._plain(rest), strict=True)
        return b"".join([known[x] for x in chunks])


def tails(texts: pa.StringArray, heads: pa.StringArray) -> pa.StringArray:
    """What follows in each text after its head."""
    if not len(texts):
        return texts
    ends = np.frombuffer(texts.buffers()[1], "<i4", texts.offset + len(texts) + 1)[texts.offset + 1 :]
    sizes = pc.subtract(pc.binary_length(texts), pc.binary_length(heads)).to_numpy()
    cuts = np.r_[0, np.cumsum(sizes)].astype("<i4")
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(cuts), pa.py_buffer(raw[np.repeat(ends - cuts[1:], sizes) + np.arange(cuts[-1])]))


_LOADED: dict[str, ByteBpe] = {}


def loaded(file: str) -> ByteBpe:
    if file not in _LOADED:
        _LOADED[file] = ByteBpe(file)
        gc.freeze()  # the tables stay; they need not be looked through again and again
    return _LOADED[file]


class Writer:
    """Writes one file to a stream. add() takes documents in the order they get."""

    def __init__(self, out, level: int = 3, frame_bytes: int = FRAME_BYTES):
        self.out, self.zip, self.frame_bytes = out, zstandard.ZstdCompressor(level=level, write_content_size=True), frame_bytes
        self.held: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(tokens) // 4)
        if self.size and self.size + len(tokens) > self.frame_bytes:
            self._frame()
        self.held.append(tokens)
        self.size += len(tokens)

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.zip.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        sink = io.BytesIO()
        index = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        with pa.ipc.new_file(sink, index.schema) as w:
            w.write_table(index)
        body = sink.getvalue()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        rows = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(rows) + FOOTER.size) + rows + FOOTER.pack(len(self.table), 0x80, FOOTER_MAGIC))


class Reader:
    """Reads a file that can be seeked."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        at = size - FOOTER.size - 12 * n
        source.seek(at)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.table[:, 0])]
        source.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index of documents behind the frames")
        self.index = pa.ipc.open_file(pa.py_buffer(source.read(length))).read_all()
        self.sizes = self.index["n_tokens"].to_numpy() * 4
        ends = np.cumsum(self.sizes)
        self.begin = np.r_[0, ends[:-1]] if len(ends) else ends
        self.first = np.r_[0, np.cumsum(self.table[:, 1])]  # of each frame, in bytes of ids
        self.frames_read = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.source.seek(int(self.starts[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
            if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._last = k, raw
            self.frames_read += 1
        return self._last[1]

    def tokens(self, n: int) -> bytes:
        """The ids of the n-th document of the file; only its frame is decompressed."""
        size = int(self.sizes[n])
        if not size:
            return b""
        k = int(np.searchsorted(self.first, self.begin[n], "right")) - 1
        at = int(self.begin[n] - self.first[k])
        return self._frame(k)[at : at + size]


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = 0) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order; returns the manifest: part, path, n_docs, n_tokens.

    Parts hold ascending ranges of doc_id (null ids first, rows of one id in the order of the input, over several parts if
    they are many). Null texts count as empty: only the end id. A part is written under a name of its own attempt and then moved to its final name, so a task that runs
    again after a lost executor leaves the same file. folder must be one that all executors share.
    """
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = loaded(tokenizer_file), TaskContext.get().partitionId()
        fs, root = _file_system(folder)
        name, attempt = f"{root}/part-{part:06d}.zst", f"{root}/.part-{part:06d}.{uuid.uuid4().hex}"
        writer = None
        for piece in chunks(batches, 2 << 20):
            if writer is None:
                stream = fs.open_output_stream(attempt)
                writer = Writer(stream)
            for doc_id, tokens in zip(piece["doc_id"].to_pylist(), coder.encode_batch(piece["text"].combine_chunks()), strict=True):
                writer.add(doc_id, bytes(tokens) + tail)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.counts)]})

    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    return written(rows.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"))


def read_token_files(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens (binary; or their ids_crc32) of each document, from the
    files."""
    offsets = manifest.withColumn("offset", F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    files = max(1, manifest.count())
    name, kind = ("ids_crc32", "long") if digest else ("tokens", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    n = reader.index["n_tokens"].to_numpy()
                    start = (offset or 0) + reader.begin // 4
                    for a, b in runs(n, 1 << 20):
                        tokens = map(reader.tokens, range(a, b))
                        last = pa.array(map(crc32, tokens), pa.int64()) if digest else pa.array(tokens, pa.binary())
                        yield pa.RecordBatch.from_arrays([reader.index["doc_id"].slice(a, b - a).combine_chunks(), pa.array(start[a:b], pa.int64()), pa.array(n[a:b], pa.int64()), last], names=["doc_id", "start", "n_tokens", name])

    return offsets.select("path", "offset").repartition(files).mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes sum up to about most, of one place at least and 1,024 at most."""
    sums, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = int(np.searchsorted(sums, (sums[a - 1] if a else 0) + most, "right"))
        b = min(max(b, a + 1), a + 1024)
        yield a, min(b, len(sizes))
        a = b


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", folder))


def round_trip_digests(docs: DataFrame, tokenizer_file: str, end_id: int | None = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was written and read back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, tokenizer_file, folder, end_id)
    return read_token_files(manifest, folder, digest=True)
