"""Sources. Schemas are stated, never inferred; rows that do not fit are kept apart, not dropped silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "time_sec DOUBLE, frequency_hz DOUBLE, confidence DOUBLE, note_label STRING, cents_deviation DOUBLE"


def files(spark: SparkSession, folders: list[str], extensions: list[str]) -> DataFrame:
    """path, length, modificationTime of the files below the folders with one of the extensions; each path once.

    The content column is not selected, so the files are listed and not read.
    """
    glob = "*.{" + ",".join(sorted({x for e in extensions for x in (e.lower(), e.upper())})) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    found = reduce(DataFrame.unionByName, (reader.load(f).select("path", "length", "modificationTime") for f in folders))
    return found.dropDuplicates(["path"])


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha1, sha256 of each file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.select("path", F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with a column _corrupt for lines that do not fit the schema."""
    return spark.read.schema(f"{schema}, _corrupt STRING").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def tracks(spark: SparkSession, glob: str) -> DataFrame:
    """One row for each point of per-track JSON files {track_id, points: [...]}: track_id, pos and the point's fields."""
    d = spark.read.schema(f"track_id STRING, points ARRAY<STRUCT<{POINT.replace(' DOUBLE', ': DOUBLE').replace(' STRING', ': STRING')}>>").option("multiLine", True).json(glob)
    return d.select("track_id", F.posexplode("points").alias("pos", "p")).select("track_id", "pos", "p.*")


def json_lines(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows if split is None else rows.where(F.col("split") == split)


LEDGER = "stage STRING, track_id STRING, status STRING"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions below a folder: those with the marker that a job leaves when all of its tasks are committed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(x.getName()) for x in found if x.getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last finished version of a progress ledger (see writers.save_ledger), read tolerantly: stage, track_id, status;
    unreadable lines are left out. Empty if there is none."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(f"{path}/{known[-1]}")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id (file name without its ending) and vector (array of double, of length 1; a zero vector stays) of .npy files."""

    @F.pandas_udf("array<double>")
    def parse(column):
        import io

        import numpy as np

        rows = [np.load(io.BytesIO(bytes(x)), allow_pickle=False).ravel().astype(float) for x in column]
        return column.__class__([(r / n if (n := np.linalg.norm(r)) > 0 else r).tolist() for r in rows])

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(folder)
    return f.select(F.regexp_extract("path", r"([^/]*)\.npy$", 1).alias("id"), parse("content").alias("vector"))


def revived(df: DataFrame, columns: list[str]) -> DataFrame:
    """ISO strings of the named columns as timestamps; what does not parse becomes null."""
    return reduce(lambda d, c: d.withColumn(c, F.try_to_timestamp(F.col(c))), columns, df)


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds errors: names of the rules that do not hold (or are null) for a row."""
    return df.withColumn("errors", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()))))


def notes_in_xml(df: DataFrame, column: str) -> DataFrame:
    """pos, note, tie (start, stop or null) of the <note> elements with an id in a column of markup, in their order."""
    whole = r'(?s)<note\b[^>]*\bid="[^"]+"[^>]*?(?:/>|>.*?</note>)'
    found = df.select("*", F.posexplode(F.regexp_extract_all(column, F.lit(whole), F.lit(0))).alias("pos", "_note"))
    note, tie = F.regexp_extract("_note", r'\bid="([^"]+)"', 1), F.regexp_extract("_note", r'<tie\b[^>]*\btype="([^"]+)"', 1)
    return found.select("*", note.alias("note"), F.nullif(tie, F.lit("")).alias("tie")).drop("_note")


def pcm16(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds rate, channels and samples (array of double in [-1, 1)) of RIFF/WAVE bytes; nulls where it is none."""
    schema = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(schema)
    def parse(column):
        import pandas as pd

        return pd.DataFrame([_wave(bytes(x)) if x is not None else (None, None, None) for x in column], columns=["rate", "channels", "samples"])

    return df.withColumn("_w", parse(F.col(content))).select("*", "_w.*").drop("_w")


def _wave(raw: bytes) -> tuple:
    import struct

    import numpy as np

    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None, None, None
    at, rate, channels, bits = 12, None, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
        elif name == b"data" and bits == 16:
            body = raw[at + 8 : at + 8 + size]
            return rate, channels, (np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32768.0).tolist()
        at += 8 + size + size % 2
    return None, None, None
