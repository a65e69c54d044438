"""Sinks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flattened(df: DataFrame) -> DataFrame:
    """Structs as dotted columns; arrays and maps as JSON."""

    def walk(name: str, column: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f"{name}.{f.name}", column[f.name], f.dataType)]
        return [(F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType)) else column).alias(name)]

    return df.select(*(x for f in df.schema.fields for x in walk(f.name, F.col(f"`{f.name}`"), f.dataType)))


def dataset(df: DataFrame, folder: str, private: list[str]) -> None:
    """The full records as JSON lines, a flat CSV, and JSON lines without the private columns."""
    df.write.mode("overwrite").json(f"{folder}/full")
    flattened(df).write.mode("overwrite").option("header", True).csv(f"{folder}/flat")
    df.drop(*private).write.mode("overwrite").json(f"{folder}/lite")


def ingest(rows: DataFrame, known: DataFrame, key: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(new valid rows, rejected rows with their errors); rows whose key is known are passed over. Nothing is written, so
    this is the dry run, too; the caller appends the first and reports the second."""
    from .readers import validated

    new = validated(rows.join(known.select(key).distinct(), key, "left_anti"), rules)
    return new.where(F.size("errors") == 0).drop("errors"), new.where(F.size("errors") > 0)


def resumed_log(log: DataFrame, more: DataFrame, step: int) -> DataFrame:
    """A metrics log cut at the step that is resumed from, with the rows that follow."""
    return log.where(F.col("step") <= step).unionByName(more.where(F.col("step") > step))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; of this machine only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="fathom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def csv(df: DataFrame, path: str) -> None:
    flattened(df).write.option("header", True).csv(path)


def save_ledger(df: DataFrame, path: str) -> int:
    """A progress ledger (stage, track_id, status) as the next version below path; its number. Readers take the last
    version that is finished, so a job that dies half way leaves the version before. A number is claimed by a file that only
    one writer can make, so two writers never write the same version."""
    from .readers import versions

    number = (versions(df.sparkSession, path) or [-1])[-1] + 1
    while not _claimed(df.sparkSession, f"{path}/claims/{number}"):
        number += 1
    df.select("stage", "track_id", "status").write.mode("errorifexists").json(f"{path}/{number}")
    return number


def _claimed(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if it is there already."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(file)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """df as it is now, kept in a table of its own and read from there; later changes of its sources do not reach it."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
