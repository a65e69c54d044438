"""How the concepts are drawn from the test tables; the SQL beside each view says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.pitch import DEGREES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Pitch frames: track, t (seconds), hz, conf, ord."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("track"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("hz"), (F.col("event_id") % 100 / 100.0).alias("conf"), F.col("event_id").alias("ord"))


FRAMES = "frames AS (SELECT user_id AS track, epoch_us(ts) / 1e6 AS t, value AS hz, (event_id % 100) / 100.0 AS conf, event_id AS ord FROM events)"
_REF = ", ".join(f"('{n}', {r}, {k})" for k, (n, r) in enumerate(DEGREES))
FOLD = "(((1200 * log2({hz} / {ref}) + 600) % 1200 + 1200) % 1200 - 600)"
POINTS = f"""{FRAMES}, degrees(note, ref, k) AS (VALUES {_REF}),
points AS (SELECT * EXCLUDE (rn) FROM (SELECT f.*, note, {FOLD.format(hz="hz", ref="ref")} AS cents,
  row_number() OVER (PARTITION BY ord ORDER BY abs({FOLD.format(hz="hz", ref="ref")}), k) AS rn FROM frames f, degrees WHERE conf >= 0.8 AND hz > 0) WHERE rn = 1)"""


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings: id, title (first line), transcript, genre, artist_name, status, created (a number), deleted_at."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    line = F.split(F.col("text"), "\n", 2)
    j = d.join(labels, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("id"), line[0].alias("title"), F.coalesce(F.get(line, F.lit(1)), F.lit("")).alias("transcript"), F.col("lang").alias("genre"), F.col("source").alias("artist_name"),
        F.when(F.col("quality") == 1, "published").when(F.col("quality") == 0, "review").otherwise("draft").alias("status"), (F.col("doc_id") * 7919 % 100003).alias("created"), F.when(F.col("doc_id") % 17 == 0, F.col("doc_id")).alias("deleted_at"), "n_chars",
    )


RECORDINGS = """rec AS (SELECT d.doc_id AS id, string_split(text, chr(10))[1] AS title,
  CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS transcript, lang AS genre, source AS artist_name,
  CASE quality WHEN 1 THEN 'published' WHEN 0 THEN 'review' ELSE 'draft' END AS status, d.doc_id * 7919 % 100003 AS created,
  CASE WHEN d.doc_id % 17 = 0 THEN d.doc_id END AS deleted_at, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def thousandths(c):
    """As a whole number of thousandths, so that sums in another order compare equal."""
    return F.round(c * 1000).cast("long")
