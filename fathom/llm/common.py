"""Shared helpers: tables, the shared folder, durable intermediate tables and Arrow mapping."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset, a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="fathom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, codec: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage, survives lost executors.

    Costs one computation, unlike ``checkpoint()``, which computes its input twice. group_rows: the most rows of a row group,
    for rows of several MB: Parquet looks at the size of a group after 100 rows first, and arrays are read a group at once.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame, most_bytes: int = 4 << 20, most_rows: int = 1000) -> DataFrame:
    """df, after the session's Arrow batches were bounded: 10,000 whole texts in one would take tens of MB, in the JVM and
    again in each Python worker. Smaller bounds that the session has already stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxBytesPerBatch", most_bytes), ("maxRecordsPerBatch", most_rows)):
        now = re.fullmatch(r"(-?\d+)b?", conf.get(f"spark.sql.execution.arrow.{name}"))
        if now and not 0 < int(now[1]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """The rows in order, in tables of about most_bytes (one longer row is a table of its own)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rest = batch.slice(start)
            n = rest.num_rows
            if rest.nbytes > most_bytes:
                n = max(1, int(n * most_bytes / rest.nbytes))
            held.append(rest.slice(0, n))
            size += held[-1].nbytes
            start += n
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def as_list(texts: pa.Array) -> list[str]:
    """The strings of an array without nulls; to_pylist() makes a scalar of each and takes eight times as long."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts parted at each space and before each line end: the distinct words, each word's place among them, and where each
    text's words begin (and the end). A space stands before each word of a text but its first, unless it begins with a line
    end. Work on words is then done once for each distinct one."""
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    coded = parts.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), parts.offsets.to_numpy()


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What coded_words() gives, with the words as a list."""
    words, index, edges = coded_words(texts)
    return as_list(words), index, edges


def strung(values: list[bytes] | pa.LargeBinaryArray, index: np.ndarray, edges: np.ndarray) -> list[memoryview]:
    """For each text the values of its words in a row; index and edges as from distinct_words()."""
    got = (values if isinstance(values, pa.LargeBinaryArray) else pa.array(values, pa.large_binary())).take(pa.array(index))
    _, ends, data = got.buffers()
    cuts = np.frombuffer(ends, "<i8", len(got) + 1)[edges] if len(got) else np.zeros(len(edges), np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def hand_back() -> None:
    """Returns what a task has freed to the system. Python workers live on and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
