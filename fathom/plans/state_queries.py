"""Keyed state in batch form; the streaming forms are in fathom.streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import pitch
from fathom.operators import stateful
from fathom.sources import writers
from fathom.streaming import keyed, queues, run

from . import query
from .data import FRAMES, frames, table


@query(f"""WITH RECURSIVE {FRAMES}, f AS (SELECT track, t, ord, row_number() OVER (PARTITION BY track ORDER BY t, ord) AS n FROM frames),
s(track, n, ord, start, win, hits) AS (SELECT track, n, ord, t, 0, 1 FROM f WHERE n = 1
  UNION ALL SELECT f.track, f.n, f.ord, CASE WHEN t - start >= 86400 THEN t ELSE start END, win + CASE WHEN t - start >= 86400 THEN 1 ELSE 0 END, CASE WHEN t - start >= 86400 THEN 1 ELSE hits + 1 END FROM s JOIN f ON f.track = s.track AND f.n = s.n + 1)
SELECT track, ord, CAST(win AS INT) AS win, CAST(hits AS INT) AS hits, hits <= 5 AS allowed FROM s""")
def ST2_rate_windows(spark, sf):
    f = frames(spark, sf).select("track", "t", "ord")
    return stateful.fixed_windows(f, "track", "t", "ord", 86400.0, 5)


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM e""")
def ST4_U13_failures_since_success(spark, sf):
    order = ["ts", "event_id"]
    w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf, "events").withColumn("isl", F.sum((F.col("event_type") == "purchase").cast("int")).over(w))
    w = Window.partitionBy("user_id", "isl").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.sum((F.col("event_type") == "error").cast("long")).over(w).alias("failures"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'stale' WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY user_id""")
def ST5_ST9_job_status(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    g = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("ts")).join(F.broadcast(now))  # one row is sent
    return g.select("user_id", "last", F.when(F.col("ts") < F.col("now") - F.expr("INTERVAL 1 DAY"), "stale").when(F.col("last") == "error", "failed").otherwise("running").alias("status"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, max(ts) + INTERVAL 2 DAY AS until FROM events WHERE event_type = 'error' GROUP BY user_id) b WHERE b.user_id = e.user_id AND e.ts < b.until)")
def ST12_blacklist_with_expiry(spark, sf):
    e = table(spark, sf, "events")
    b = e.where("event_type = 'error'").groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("until"))
    return e.join(b, "user_id", "left").where(F.col("until").isNull() | (F.col("ts") >= F.col("until"))).select("event_id")


def as_queue(spark, sf, kinds, folder):
    """The events as a stream of k, ts, seq, kind; kinds renames the event types, others are left out."""
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    rows = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind")).where("kind IS NOT NULL")
    return keyed.as_stream(run.from_table(rows, f"{folder}/in"), late="0 seconds")


OUTCOMES = {"error": "transient", "purchase": "ok", "signup": "permanent"}


@query("""WITH o AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS t, event_id AS seq, CASE event_type WHEN 'error' THEN 'transient' WHEN 'purchase' THEN 'ok' ELSE 'permanent' END AS kind FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
n AS (SELECT *, row_number() OVER w AS tries FROM o WINDOW w AS (PARTITION BY k ORDER BY t, seq)),
e AS (SELECT *, coalesce(max(CASE WHEN kind <> 'transient' OR tries > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM n),
a AS (SELECT *, lead(t) OVER (PARTITION BY k ORDER BY t, seq) AS next, t + 30000 * CAST(pow(2, tries - 1) AS BIGINT) AS until FROM e WHERE ended = 0)
SELECT k, t AS "at", CASE WHEN kind = 'ok' THEN 'complete' WHEN kind = 'permanent' THEN 'rejected' WHEN tries > 3 THEN 'failed' ELSE 'waiting' END AS action, CAST(tries AS INT) AS number, CASE WHEN kind = 'transient' AND tries <= 3 THEN until END AS until FROM a
UNION ALL SELECT k, until, 'retry', CAST(tries AS INT), NULL FROM a WHERE kind = 'transient' AND tries <= 3 AND until <= coalesce(next, (SELECT max(t) FROM o))""")
def ST10_retry_queue(spark, sf):
    """Each user's errors, purchases and signups as outcomes of tries; the events are replayed as a stream."""
    folder = writers.scratch(spark)
    return run.to_end(queues.retries(as_queue(spark, sf, OUTCOMES, folder), "k"), folder)


RUNS = {"click": "submit", "view": "beat", "purchase": "done", "error": "error"}
LEASE_MS = 6 * 3600 * 1000


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n, CASE event_type WHEN 'click' THEN 'submit' WHEN 'view' THEN 'beat' WHEN 'purchase' THEN 'done' ELSE 'error' END AS kind
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error')),
s(k, n, status, number, until, t, kind, lapsed, was) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), '', 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '', CAST(NULL AS BIGINT), '' FROM o
  UNION ALL SELECT k, n, CASE WHEN kind = 'submit' AND now <> 'done' THEN 'running' WHEN now = 'running' AND kind <> 'beat' THEN kind ELSE now END, CASE WHEN kind = 'submit' AND now NOT IN ('running', 'done') THEN number + 1 ELSE number END,
    CASE WHEN kind = 'submit' AND now NOT IN ('running', 'done') OR kind = 'beat' AND now = 'running' THEN t + {LEASE_MS} WHEN now = 'running' AND kind = 'submit' THEN until END, t, kind, lapsed, now
  FROM (SELECT o.k, o.n, o.t, o.kind, s.number, s.until, CASE WHEN s.status = 'running' AND s.until <= o.t THEN s.until END AS lapsed, CASE WHEN s.status = 'running' AND s.until <= o.t THEN 'ghost' ELSE s.status END AS now FROM s JOIN o ON o.k = s.k AND o.n = s.n + 1))
SELECT k, t AS "at", CASE WHEN kind <> 'submit' THEN kind WHEN was = 'running' THEN 'joined' WHEN was = 'done' THEN 'finished' ELSE 'started' END AS action, CAST(number AS INT) AS number, CASE WHEN kind = 'submit' AND was <> 'done' THEN until END AS until
FROM s WHERE n > 0 AND (kind = 'submit' OR was = 'running' AND kind <> 'beat')
UNION ALL SELECT k, lapsed, 'ghost', CAST(number - CASE WHEN kind = 'submit' THEN 1 ELSE 0 END AS INT), NULL FROM s WHERE lapsed IS NOT NULL
UNION ALL SELECT k, until, 'ghost', CAST(number AS INT), NULL FROM s WHERE status = 'running' AND until <= (SELECT max(t) FROM o) AND n = (SELECT max(n) FROM o WHERE o.k = s.k)""")
def ST9_S24_single_runs(spark, sf):
    """Clicks submit a user's job, views are its worker's signs of life, purchases and errors end it."""
    folder = writers.scratch(spark)
    return run.to_end(queues.single_runs(as_queue(spark, sf, RUNS, folder), "k", LEASE_MS), folder)


def _checked(row):
    if row["o_orderkey"] % 7 == 0:
        raise ValueError("order is not readable")
    return {"digits": len(str(row["o_orderkey"]))}


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN len(CAST(o_orderkey AS VARCHAR)) END) AS BIGINT) AS digits FROM orders GROUP BY ALL")
def X1_ST15_resumed_stage(spark, sf):
    """The stage runs, more files arrive (with some of the first ones again), and it runs again; the last ones are yet to come."""
    folder, o = writers.scratch(spark), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    stage = run.Stage("check", f"{folder}/stage", "o_orderkey", _checked, "digits long")
    for part in (o.where("o_orderkey % 5 < 3 AND o_orderkey % 5 > 0"), o.where("o_orderkey % 5 > 1")):
        part.write.mode("append").parquet(f"{folder}/in")
        stage.run(spark.readStream.schema(o.schema).parquet(f"{folder}/in"))
    states = stage.ledger(o).select(F.col("track_id").cast("long").alias("o_orderkey"), "status").join(stage.results(spark, "long").select("o_orderkey", "digits"), "o_orderkey", "left")
    return states.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("digits").alias("digits"))


def thousandths_of(df, columns):
    return df.select(*(F.round(F.col(c) * 1000).cast("long").alias(c) if c in columns else c for c in df.columns))


#: The automaton on lists: the frames of the note and those of an excursion are kept whole, and medians taken anew.
@query(f"""WITH RECURSIVE {FRAMES}, f AS (SELECT track, t, CASE WHEN hz > 0 THEN 6900 + 1200 * log2(hz / 440) END AS c, conf AS q, row_number() OVER (PARTITION BY track ORDER BY t) AS n FROM frames),
hops AS (SELECT track, coalesce(median(d), 0) AS hop FROM (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS d FROM f) GROUP BY track),
s(track, n, note, away, ended) AS (SELECT DISTINCT track, CAST(0 AS BIGINT), CAST([] AS STRUCT(t DOUBLE, c DOUBLE, q DOUBLE)[]), CAST([] AS STRUCT(t DOUBLE, c DOUBLE, q DOUBLE)[]), CAST([] AS STRUCT(t DOUBLE, c DOUBLE, q DOUBLE)[]) FROM f
  UNION ALL SELECT track, n, CASE WHEN what = 'begin' THEN [x] WHEN what = 'in' THEN list_append(list_concat(note, away), x) WHEN what = 'settle' THEN list_append(away, x) WHEN what = 'close' THEN [] ELSE note END,
    CASE WHEN what IN ('in', 'settle', 'close', 'begin') THEN [] WHEN what = 'out' THEN list_append(away, x) ELSE away END, CASE what WHEN 'settle' THEN note WHEN 'close' THEN list_concat(note, away) ELSE [] END
  FROM (SELECT f.track, f.n, note, away, {{'t': f.t, 'c': f.c, 'q': f.q}} AS x, CASE WHEN f.c IS NOT NULL AND f.q >= 0.5 THEN CASE WHEN len(note) = 0 THEN 'begin' WHEN abs(f.c - list_median(list_transform(note, lambda y: y.c))) < 80 THEN 'in' WHEN len(away) + 1 >= 2 THEN 'settle' ELSE 'out' END
      WHEN len(note) > 0 AND f.t - list_concat(note, away)[-1].t <= 86400 THEN 'wait' ELSE 'close' END AS what FROM s JOIN f ON f.track = s.track AND f.n = s.n + 1)),
notes AS (SELECT track, ended AS x FROM s WHERE len(ended) > 0 UNION ALL SELECT s.track, list_concat(note, away) FROM s JOIN (SELECT track, max(n) AS n FROM f GROUP BY track) l ON s.track = l.track AND s.n = l.n WHERE len(note) > 0)
SELECT track, CAST(round(x[1].t * 1000) AS BIGINT) AS start, CAST(round((x[-1].t + hop) * 1000) AS BIGINT) AS "end", CAST(round(list_median(list_transform(x, lambda y: y.c)) * 1000) AS BIGINT) AS cents, CAST(round(list_avg(list_transform(x, lambda y: y.q)) * 1000) AS BIGINT) AS confidence
FROM notes JOIN hops USING (track) WHERE x[-1].t + hop - x[1].t >= 0.08""")
def W7_settled_notes(spark, sf):
    f = frames(spark, sf).withColumn("cents", pitch.hz_to_cents(F.col("hz")))
    return thousandths_of(stateful.settle_notes(f, "track", settle=2, gap=86400.0), ["start", "end", "cents", "confidence"])


@query(f"""WITH RECURSIVE {FRAMES}, f AS (SELECT track, t AS s, t + hz * 100 AS e, conf AS a, row_number() OVER (PARTITION BY track ORDER BY t, conf DESC, t + hz * 100) AS n FROM frames),
r(track, n, s, e, a, ds, de, da) AS (SELECT track, n, s, e, a, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM f WHERE n = 1
  UNION ALL SELECT track, n, CASE WHEN hidden THEN s0 ELSE s END, CASE WHEN hidden THEN e0 ELSE e END, CASE WHEN hidden THEN a0 ELSE a END, CASE WHEN NOT hidden THEN s0 END, least(e0, s), a0
  FROM (SELECT f.*, r.s AS s0, r.e AS e0, r.a AS a0, f.s < r.e AND f.a <= r.a * 1.2 AS hidden FROM r JOIN f ON f.track = r.track AND f.n = r.n + 1)),
line AS (SELECT track, ds AS s, de AS e, da AS a FROM r WHERE ds IS NOT NULL UNION ALL SELECT r.track, s, e, a FROM r JOIN (SELECT track, max(n) AS n FROM f GROUP BY track) l ON r.track = l.track AND r.n = l.n)
SELECT track, CAST(round(s * 1000) AS BIGINT) AS start, CAST(round(e * 1000) AS BIGINT) AS "end", CAST(round(a * 1000) AS BIGINT) AS amp FROM line WHERE e - s >= 0.05""")
def W8_J22_skyline(spark, sf):
    f = frames(spark, sf).select("track", F.col("t").alias("start"), (F.col("t") + F.col("hz") * 100).alias("end"), F.col("conf").alias("amp"))
    return thousandths_of(stateful.skyline(f, "track"), ["start", "end", "amp"])


@query("""WITH last AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 3 = 2 THEN 'draft' ELSE 'published' END AS status, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS docs, count(*) * 2 AS weight FROM last WHERE status = 'published' AND term <> '' GROUP BY term HAVING count(DISTINCT doc_id) >= 10""")
def ST8_incremental_index(spark, sf):
    """Three batches of changes: some documents are published, others follow, and some of the first are taken back."""
    path, d = writers.scratch(spark), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    change = keyed.index_changes(path, "id", {"text": 2.0}, buckets=16)
    for number, (rows, status) in enumerate((("id % 3 = 0", "published"), ("id % 3 = 1", "published"), ("id % 6 = 0", "archived"))):
        change(d.where(rows).withColumns({"seq": F.lit(number), "status": F.lit(status)}), number)
    found = keyed.index_postings(spark, path, spark.createDataFrame([], f"id {d.schema['id'].dataType.simpleString()}, term string, weight double").schema)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("weight").cast("long").alias("weight")).where("docs >= 10")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def EXT_tumbling_window(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
