"""Streams: merging of late stages, mirrors of the last event, windows, rate limits, lockouts, jobs, values that expire.

State is kept for each key and ends by a timer or a watermark, so it does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from fathom.operators import search
from fathom.sources import readers


def as_stream(df: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a watermark (a timestamp without a zone cannot carry one)."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def merged_stages(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The last value that is not null of each field of each key, in whatever order the stages arrive (output mode update)."""
    return events.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def mirror(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last event of each key, by its own order and not by its arrival (output mode update)."""
    return events.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in columns), F.max(order).alias(order))


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event with the keys within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str, by: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, width: str, step: str, by: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.window(time, width, step), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, by: list[str], time: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))


def _keyed(events: DataFrame, key: str, step: Callable, output: str, state: str, keep_ms: int) -> DataFrame:
    """step(state tuple or None, time in ms, row) gives (state tuple, output tuple) for each event of a key, by time.

    A key that is silent for keep_ms of event time is forgotten.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, out, last = held.get if held.exists else None, [], 0
        for frame in frames:
            for row in frame.sort_values("ts", kind="stable").itertuples(index=False):
                last = int(row.ts.timestamp() * 1000)
                now, said = step(now, last, row)
                out.append((k[0], *said))
        held.update(now)
        held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame(out, columns=[key, *(x.strip().split()[0] for x in output.split(","))])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {output}", state, "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, key: str, window_ms: int, limit: int) -> DataFrame:
    """key, at, hits, allowed: windows begin with the first hit after the last one ended. events: key, ts (watermarked)."""

    def step(now, t, row):
        start, n = now if now and t - now[0] < window_ms else (t, 0)
        return (start, n + 1), (t, n + 1, n + 1 <= limit)

    return _keyed(events, key, step, "at long, hits int, allowed boolean", "start long, n int", window_ms)


def lockout(events: DataFrame, key: str, most: int, lock_ms: int, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """key, at, failures, locked: so many failures in a row lock the key for a time. events: key, ts, ok.

    Only a success sets the count back; it stays when a lock ends, so the next failure locks again. While a key is locked
    nothing is counted. The count of a key that is silent for keep_ms is forgotten.
    """

    def step(now, t, row):
        failures, until = now or (0, 0)
        if t < until:
            return (failures, until), (t, failures, True)
        failures = 0 if row.ok else failures + 1
        until = t + lock_ms if failures >= most else 0
        return (failures, until), (t, failures, bool(until))

    return _keyed(events, key, step, "at long, failures int, locked boolean", "failures int, until long", keep_ms)


def jobs(events: DataFrame, key: str, stale_ms: int) -> DataFrame:
    """key, at, status: queued, running, then succeeded or failed for good; a job silent for stale_ms fails. events: key, ts, kind."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            status, at = held.get
            held.remove()
            if status in ("queued", "running"):
                yield pd.DataFrame([(k[0], at + stale_ms, "failed")], columns=[key, "at", "status"])
            return
        status, at = held.get if held.exists else (None, 0)
        out = []
        for frame in frames:
            for row in frame.sort_values("ts", kind="stable").itertuples(index=False):
                t = int(row.ts.timestamp() * 1000)
                if status not in ("succeeded", "failed") and row.kind != status:
                    status, at = row.kind, t
                    out.append((k[0], t, status))
                at = max(at, t)
        held.update((status, at))
        held.setTimeoutTimestamp(max(at, held.getCurrentWatermarkMs()) + stale_ms)
        yield pd.DataFrame(out, columns=[key, "at", "status"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at long, status string", "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def expiring(events: DataFrame, key: str, ttl_ms: int, refresh: bool) -> DataFrame:
    """key, at, hit: whether a value written earlier still stands when the key is asked for. events: key, ts, kind (put or get).

    refresh: every write starts the time anew; else it runs from the first write.
    """

    def step(now, t, row):
        until = now[0] if now and t < now[0] else 0
        if row.kind == "put":
            until = t + ttl_ms if refresh or not until else until
        return (until,), (t, row.kind == "get" and until > 0)

    return _keyed(events, key, step, "at long, hit boolean", "until long", ttl_ms)


INDEX_BUCKETS = 64
#: Text and postings that a task of a batch gets, about; more of them are more tasks, not larger ones.
TASK_BYTES, TASK_POSTINGS = 8 << 20, 500_000


def index_changes(path: str, key: str, weights: dict[str, float], buckets: int = INDEX_BUCKETS, task_bytes: int = TASK_BYTES, task_postings: int = TASK_POSTINGS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the postings of published rows enter the index below path, those of other rows leave it. Rows have
    the key, seq (the last one of a key counts), status and the fields of weights.

    Postings are dealt to buckets by their document. A batch writes those buckets anew that its documents fall into, and a
    manifest that names for each bucket the batch that wrote it last. A batch that runs again replaces its own files only,
    and readers see a batch when its manifest is finished.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in weights if c in batch.columns]
        size, least = batch.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        last = batch.repartition(max(least, -(-size // task_bytes)), key).groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "seq").alias("r")).select(key, "r.*")
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r.bucket for r in last.select(bucket.alias("bucket")).distinct().collect()]  # the number of buckets bounds them
        before = {k: n for k, n in index_manifest(spark, path, number).items() if n < number}
        new = search.postings(last.where("status = 'published'"), key, weights)
        old = index_postings(spark, path, new.schema, {k: n for k, n in before.items() if k in touched})
        rows = old.join(last.select(key), key, "left_anti").unionByName(new).withColumn("bucket", bucket)
        # of new text about one posting for eight bytes
        slices = -(-max(1, (old.count() + size // 8) // task_postings) // buckets)
        rows.repartition(max(least, buckets * slices), "bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(slices))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
        written = spark.read.schema("bucket int").parquet(f"{path}/data/{number}").distinct().collect()
        now = {k: n for k, n in before.items() if k not in touched} | {r.bucket: number for r in written}
        spark.createDataFrame(list(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{number}")

    return run


def index_manifest(spark: SparkSession, path: str, before: int = 1 << 62) -> dict[int, int]:
    """The batch that wrote each bucket last, of the last finished manifest (with a smaller number)."""
    known = [n for n in readers.versions(spark, f"{path}/manifest") if n < before]
    rows = spark.read.schema("bucket int, batch int").json(f"{path}/manifest/{known[-1]}").collect() if known else []
    return {r.bucket: r.batch for r in rows}


def index_postings(spark: SparkSession, path: str, schema: StructType, manifest: dict[int, int] | None = None) -> DataFrame:
    """The postings of all buckets, or of those of a manifest."""
    manifest = index_manifest(spark, path) if manifest is None else manifest
    paths = [f"{path}/data/{n}/bucket={k}" for k, n in sorted(manifest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
