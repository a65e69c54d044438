"""Running a stream to its end, and stages over items that go on where they were stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """State with timers is kept in RocksDB; the session has its own setting again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def to_end(stream: DataFrame, folder: str) -> DataFrame:
    """All rows that come out of a stream until its source has no more; a later call with the same folder goes on from there.

    Each batch is a folder of its own, written anew if the batch runs again, so no row is there twice.
    """
    spark = stream.sparkSession

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with rocks(spark):
        q = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("batch")


def from_table(rows: DataFrame, folder: str) -> DataFrame:
    """A finished table as a stream."""
    rows.write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


class Stage:
    """Calls process(row as a dict) for each item of a stream; gives a dict of the output's columns.

    An item that fails is a row with its error, and the run goes on. Items that an earlier batch has finished are passed
    over, as are repeated ones. The source's checkpoint says which files were read, so a run that was killed goes on with
    the batch that it was in: that batch runs again and replaces what it wrote. Keys are not null.
    """

    def __init__(self, name: str, folder: str, key: str, process: Callable[[dict[str, Any]], dict[str, Any]], output: str):
        self.name, self.folder, self.key, self.process = name, folder.rstrip("/"), key, process
        self.output = T.StructType.fromDDL(output)

    def _schema(self, rows: DataFrame) -> T.StructType:
        own = [T.StructField(self.key, rows.schema[self.key].dataType), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]
        return T.StructType([*own, *self.output.fields])

    def _handled(self, rows: DataFrame) -> DataFrame:
        schema, key, process, names = self._schema(rows), self.key, self.process, self.output.names
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        got = process(row)
                        one = {key: row[key], "status": "done", "error": None} | {n: got.get(n) for n in names}
                        pa.RecordBatch.from_pylist([one], arrow)  # a value of another type is this item's error
                    except Exception as e:  # noqa: BLE001  one bad item must not end the run
                        one = {key: row[key], "status": "failed", "error": str(e)[:500]} | dict.fromkeys(names)
                    out.append(one)
                yield pa.RecordBatch.from_pylist(out, arrow)

        return rows.mapInArrow(run, schema)

    def _finished(self, spark: SparkSession, schema: T.StructType, before: int) -> DataFrame:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{self.folder}/items").parquet(f"{self.folder}/items").where(F.col("batch") < before)

    def run(self, items: DataFrame) -> None:
        """items: a stream; all that its source has now is handled."""
        schema = self._schema(items)

        def batch(rows: DataFrame, number: int) -> None:
            todo = rows.dropDuplicates([self.key])
            if number:
                todo = todo.join(self._finished(rows.sparkSession, schema, number).where("status = 'done'").select(self.key), self.key, "left_anti")
            self._handled(todo).write.mode("overwrite").parquet(f"{self.folder}/items/batch={number}")

        q = items.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
        q.awaitTermination()

    def results(self, spark: SparkSession, key_type: str) -> DataFrame:
        """The last word on each item: key, status, error and the output's columns; a finished item stays finished."""
        schema = T.StructType.fromDDL(f"`{self.key}` {key_type}").add("status", "string").add("error", "string")
        rows = self._finished(spark, T.StructType([*schema.fields, *self.output.fields]), 1 << 62)
        rest = [c for c in rows.columns if c not in (self.key, "batch")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(F.col("status") == "done", "batch")).alias("r")).select(self.key, "r.*")

    def ledger(self, items: DataFrame) -> DataFrame:
        """stage, track_id, status of all items: done, failed or pending."""
        kind = items.schema[self.key].dataType.simpleString()
        own = self.results(items.sparkSession, kind).select(self.key, "status")
        return items.select(self.key).distinct().join(own, self.key, "left").select(F.lit(self.name).alias("stage"), F.col(self.key).cast("string").alias("track_id"), F.coalesce("status", F.lit("pending")).alias("status"))
