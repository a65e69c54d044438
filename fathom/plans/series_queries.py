"""Pitch series, statistics and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import pitch
from fathom.operators import series, stats

from . import query
from .data import FOLD, FRAMES, POINTS, frames, table, thousandths


def points(spark, sf):
    return series.mapped(frames(spark, sf))


@query(f"""WITH {POINTS}, g AS (SELECT track, note, count(*) AS n, sum(CAST(conf AS DECIMAL(18, 9))) AS w, avg(cents) AS m FROM points GROUP BY ALL)
SELECT track, note, n, CAST(round(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY track) AS DOUBLE) * 1000) AS BIGINT) AS share, CAST(round(m * 1000) AS BIGINT) AS mean_cents FROM g""")
def A1_note_statistics(spark, sf):
    s = series.note_statistics(points(spark, sf))
    return s.select("track", "note", "n", thousandths(F.col("share")).alias("share"), thousandths(F.col("mean_cents")).alias("mean_cents"))


@query(f"""WITH {POINTS}, g AS (SELECT track, note, sum(CAST(conf AS DECIMAL(18, 9))) AS w FROM points GROUP BY ALL), s AS (SELECT *, round_even(CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY track) AS DOUBLE), 3) AS share FROM g)
SELECT track, string_agg(note, ',' ORDER BY share DESC, note) AS dominant FROM s WHERE share >= 0.05 GROUP BY track""")
def A2_dominant_notes(spark, sf):
    s = series.note_statistics(points(spark, sf)).withColumn("share", F.bround("share", 3)).where("share >= 0.05")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "note")))
    return s.groupBy("track").agg(F.array_join(F.transform(ordered, lambda x: x["note"]), ",").alias("dominant"))


@query(f"""WITH {FRAMES} SELECT track, CAST(round(count(*) FILTER (conf >= 0.8 AND hz > 0) / count(*) * 1000) AS BIGINT) AS voiced, CAST(round((max_by(t, ord) - min(t)) * 1000) AS BIGINT) AS last_t FROM frames GROUP BY track""")
def A3_recording_rollup(spark, sf):
    f = frames(spark, sf)
    return f.groupBy("track").agg(thousandths(F.count_if((F.col("conf") >= 0.8) & (F.col("hz") > 0)) / F.count(F.lit(1))).alias("voiced"), thousandths(F.max_by("t", "ord") - F.min("t")).alias("last_t"))


@query(f"""WITH {POINTS} SELECT note, count(*) AS n, CAST(round(avg(cents) * 1000) AS BIGINT) AS mean, CAST(round(median(cents) * 1000) AS BIGINT) AS median, CAST(round(stddev_pop(cents) * 1000) AS BIGINT) AS std,
 CAST(round(avg(abs(cents)) * 1000) AS BIGINT) AS mean_abs, CAST(round(avg(CASE WHEN abs(cents) > 50 THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS beyond FROM points GROUP BY GROUPING SETS ((note), ())""")
def A4_degree_statistics(spark, sf):
    s = stats.summary_with_overall(points(spark, sf), "cents", "note")
    return s.select("note", "n", *(thousandths(F.col(c)).alias(c) for c in ("mean", "median", "std", "mean_abs", "beyond")))


PATTERN = [0, 200, 400, 700, 900]
PC = "least(1199, CAST(floor(((1200 * log2(hz / 293.66)) % 1200 + 1200) % 1200) AS INT))"


@query(f"""WITH {FRAMES}, b AS (SELECT track, {PC} AS bin, count(*) AS h FROM frames WHERE hz > 0 GROUP BY ALL),
s AS (SELECT track, ((bin + k - p) % 1200 + 1200) % 1200 AS o, sum(h * (21 - abs(k))) AS score FROM b, (SELECT unnest([0, 200, 400, 700, 900]) AS p), (SELECT unnest(range(-20, 21)) AS k) GROUP BY ALL),
m AS (SELECT track, CAST(o AS INT) AS o, row_number() OVER (PARTITION BY track ORDER BY score DESC, o) AS rn FROM s), n AS (SELECT track, CAST(sum(h) AS BIGINT) AS n FROM b GROUP BY track)
SELECT track, n AS n_frames, CASE WHEN n >= 20 THEN o END AS "offset" FROM n JOIN m USING (track) WHERE rn = 1""")
def A5_grid_fit(spark, sf):
    return series.grid_fit(frames(spark, sf).where("hz > 0"), PATTERN, least=20)


@query(f"""WITH {POINTS} SELECT note, CAST(least(floor((cents + 150) / 10), 29) AS BIGINT) AS bin, count(*) AS n FROM points WHERE cents BETWEEN -150 AND 150 GROUP BY ALL""")
def A6_binned_histogram(spark, sf):
    p = points(spark, sf).where(F.col("cents").between(-150, 150))
    return p.groupBy("note", F.least(F.floor((F.col("cents") + 150) / 10), F.lit(29)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {POINTS}, t AS (SELECT track, avg(abs(cents)) AS d FROM points GROUP BY track)
SELECT count(*) AS n, CAST(round(avg(d) * 1000) AS BIGINT) AS mean, CAST(round(quantile_cont(d, 0.1) * 1000) AS BIGINT) AS p10, CAST(round(quantile_cont(d, 0.5) * 1000) AS BIGINT) AS p50, CAST(round(quantile_cont(d, 0.9) * 1000) AS BIGINT) AS p90 FROM t""")
def A7_track_percentiles(spark, sf):
    t = points(spark, sf).groupBy("track").agg(F.avg(F.abs("cents")).alias("d"))
    all_ = t.agg(F.count(F.lit(1)).alias("n"), thousandths(F.avg("d")).alias("mean"))
    p = stats.quantiles(t, "d", [], [0.1, 0.5, 0.9])
    return stats.beside(all_, p.select(*(thousandths(F.col(c)).alias(c) for c in p.columns)), [])


@query("""WITH v AS (SELECT event_type AS g, value AS x FROM events WHERE event_type IN ('click', 'purchase')), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM v),
t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM v GROUP BY x)), c AS (SELECT count(*) FILTER (g = 'click') AS a, count(*) FILTER (g = 'purchase') AS b, sum(r) FILTER (g = 'click') AS s FROM r),
u AS (SELECT a, b, s - a * (a + 1) / 2.0 AS u, sqrt(a * b / 12.0 * (a + b + 1 - ties / ((a + b) * (a + b - 1.0)))) AS sd FROM c, t), z AS (SELECT *, greatest(0, (abs(u - a * b / 2.0) - 0.5) / sd) / sqrt(2.0) AS z FROM u), k AS (SELECT *, 1 / (1 + 0.3275911 * z) AS k FROM z)
SELECT a AS n_a, b AS n_b, CAST(round(u * 1000) AS BIGINT) AS u, CAST(round(1000 * (k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))) * exp(-z * z)) AS BIGINT) AS p FROM k""")
def A8_mann_whitney(spark, sf):
    m = stats.mann_whitney(table(spark, sf, "events"), "event_type", "value", "click", "purchase")
    return m.select("n_a", "n_b", thousandths(F.col("u")).alias("u"), thousandths(F.col("p")).alias("p"))


EVENTS = f"""{POINTS}, marked AS (SELECT *, CASE WHEN lag(note) OVER w IS NULL OR lag(note) OVER w <> note OR t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS nw FROM points WINDOW w AS (PARTITION BY track ORDER BY t, ord)),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY track ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS island FROM marked),
ev AS (SELECT track, island, any_value(note) AS note, min(t) AS s, max(t) AS e, count(*) AS n, arg_max(cents, (t, ord)) - arg_min(cents, (t, ord)) AS net, max(cents) - min(cents) AS spread FROM isl GROUP BY ALL)"""


def events(spark, sf):
    return series.note_events(points(spark, sf), gap=86400)


@query(f"WITH {EVENTS} SELECT track, CAST(island AS BIGINT) AS island, note, n, CAST(round((e - s) * 1000) AS BIGINT) AS duration FROM ev")
def W1_note_events(spark, sf):
    return events(spark, sf).select("track", "island", "note", "n", thousandths(F.col("end") - F.col("start")).alias("duration"))


@query(f"WITH {EVENTS}, x AS (SELECT *, lead(note) OVER (PARTITION BY track ORDER BY island) AS nx FROM ev) SELECT track, note || '->' || nx AS step, count(*) AS n FROM x WHERE note <> nx GROUP BY ALL")
def W2_melodic_bigrams(spark, sf):
    return series.bigrams(events(spark, sf))


@query(f"""WITH {EVENTS} SELECT CASE WHEN e - s < 0.05 THEN 'grace_note' WHEN abs(net) >= 80 THEN 'glissando' WHEN spread <= 20 THEN 'straight' ELSE 'other' END AS kind, count(*) AS n FROM ev GROUP BY ALL""")
def A9_ornament_counts(spark, sf):
    return series.ornament(events(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, d AS (SELECT track, note, sum(e - s) AS dur, sum(n) AS n FROM ev GROUP BY ALL) SELECT track, CAST(sum(n) AS BIGINT) AS n_points, CAST(round(sum(dur)) AS BIGINT) AS voiced, arg_max(note, (dur, note)) AS center FROM d GROUP BY track""")
def A12_track_summary(spark, sf):
    d = events(spark, sf).groupBy("track", "note").agg(F.sum(F.col("end") - F.col("start")).alias("dur"), F.sum("n").alias("n"))
    return d.groupBy("track").agg(F.sum("n").alias("n_points"), F.round(F.sum("dur")).cast("long").alias("voiced"), F.max_by("note", F.struct("dur", "note")).alias("center"))


@query("""SELECT o_custkey % 50 AS file, count(*) AS n, CAST(round(10 * log10(sum(o_totalprice * o_totalprice / 1e12) / count(*)) * 1000) AS BIGINT) AS rms_db, CAST(round(avg(CASE WHEN o_totalprice >= 400000 THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS clipped FROM orders GROUP BY ALL""")
def A14_rms_and_clipping(spark, sf):
    o, x = table(spark, sf, "orders"), F.col("o_totalprice")
    return o.groupBy((F.col("o_custkey") % 50).alias("file")).agg(F.count(F.lit(1)).alias("n"), thousandths(10 * F.log10(F.sum(x * x / 1e12) / F.count(F.lit(1)))).alias("rms_db"), thousandths(F.avg((x >= 400000).cast("int"))).alias("clipped"))


MIDI = "CAST(round_even((69 + 12 * log2(hz / 440)) , 0) AS BIGINT)"


@query(f"""WITH {FRAMES}, x AS (SELECT track, radians((((69 + 12 * log2(hz / 440)) * 100) % 100 + 100) % 100 * 3.6) AS a, conf + 0.01 AS w FROM frames WHERE hz > 0)
SELECT track, CAST(round(degrees(atan2(sum(w * sin(a)), sum(w * cos(a)))) / 3.6 * 1000) AS BIGINT) AS offset_cents FROM x GROUP BY track""")
def A15_tuning_offset(spark, sf):
    f = frames(spark, sf).where("hz > 0")
    return series.tuning_offset(f, pitch.hz_to_cents(F.col("hz")), F.col("conf") + 0.01).withColumn("offset_cents", thousandths(F.col("offset_cents")))


def pitch_classes(spark, sf):
    f = frames(spark, sf).where("hz > 0")
    pc = F.pmod(F.bround(pitch.hz_to_cents(F.col("hz")) / 100).cast("long"), F.lit(12)).cast("int")
    return f.groupBy("track", pc.alias("pc")).agg(F.sum(F.col("conf") + 0.01).alias("weight"))


PCS = f"{FRAMES}, pcs AS (SELECT track, CAST(({MIDI} % 12 + 12) % 12 AS INT) AS pc, sum(conf + 0.01) AS weight FROM frames WHERE hz > 0 GROUP BY ALL)"


@query(f"WITH {PCS} SELECT track, pc, CAST(round(weight * 1000) AS BIGINT) AS weight FROM pcs")
def A16_pitch_class_histogram(spark, sf):
    return pitch_classes(spark, sf).withColumn("weight", thousandths(F.col("weight")))


_T = ", ".join(f"({m}, {k}, {w})" for m, x in enumerate(series.MODES) for k, w in enumerate(series.template(x)))


@query(f"""WITH {PCS}, tpl(m, k, w) AS (VALUES {_T}), h AS (SELECT track, pc, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT track FROM pcs) CROSS JOIN (SELECT unnest(range(12)) AS pc) LEFT JOIN pcs USING (track, pc)),
c AS (SELECT track, t, m, corr(weight, CAST(w AS DOUBLE)) AS r FROM h, tpl, (SELECT unnest(range(12)) AS t) WHERE (k + t) % 12 = pc GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(r, 9) DESC, t, m) AS rn FROM c)
SELECT track, CAST(t AS INT) AS tonic, m AS mode, CAST(round(r * 1000) AS BIGINT) AS score FROM b WHERE rn = 1""")
def A17_tonic(spark, sf):
    return series.tonic(pitch_classes(spark, sf)).withColumn("score", thousandths(F.col("score")))


@query(f"""WITH {FRAMES}, x AS (SELECT track, conf + 0.01 AS w, list_min(list_transform([0, 200, 400, 700, 900], lambda d: abs((((69 + 12 * log2(hz / 440)) * 100 - d + 600) % 1200 + 1200) % 1200 - 600))) <= 50 AS ok FROM frames WHERE hz > 0)
SELECT track, CAST(round(avg(CASE WHEN ok THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS by_frames, CAST(round(sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w) * 1000) AS BIGINT) AS by_weight FROM x GROUP BY track""")
def A19_conformity(spark, sf):
    f = frames(spark, sf).where("hz > 0")
    ok = (pitch.circular_distance(pitch.hz_to_cents(F.col("hz")), F.array(*(F.lit(float(d)) for d in PATTERN))) <= 50).cast("int")
    w = F.col("conf") + 0.01
    return f.groupBy("track").agg(thousandths(F.avg(ok)).alias("by_frames"), thousandths(F.sum(w * ok) / F.sum(w)).alias("by_weight"))


@query(f"""WITH {FRAMES}, d AS (SELECT (69 + 12 * log2(hz / 440)) * 100 AS c FROM frames WHERE hz > 0), m AS (SELECT list_min(list_transform([0, 200, 400, 700, 900], lambda d: abs(((c - d + 600) % 1200 + 1200) % 1200 - 600))) AS a FROM d)
SELECT count(*) FILTER (a <= 50) AS snapped, count(*) FILTER (a > 50) AS marked, CAST(round(avg(greatest(0, 1 - a / 100)) * 1000) AS BIGINT) AS confidence FROM m""")
def A49_snap_summary(spark, sf):
    f = frames(spark, sf).where("hz > 0")
    s = f.select(pitch.snap(pitch.hz_to_cents(F.col("hz")), F.array(*(F.lit(float(d)) for d in PATTERN))).alias("s")).select("s.*")
    return s.agg(F.count_if("snapped").alias("snapped"), F.count_if("marked").alias("marked"), thousandths(F.avg("confidence")).alias("confidence"))


@query(f"""WITH {FRAMES}, x AS (SELECT track, ord, hz, CASE WHEN conf >= 0.3 THEN hz END AS v, list_sort(list(CASE WHEN conf >= 0.3 THEN hz END) FILTER (conf >= 0.3) OVER (PARTITION BY track ORDER BY t, ord ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS l FROM frames)
SELECT ord, CASE WHEN v IS NOT NULL THEN CAST(round((l[(len(l) + 1) // 2] + l[len(l) // 2 + 1]) / 2 * 1000) AS BIGINT) END AS smoothed FROM x""")
def W3_running_median(spark, sf):
    f = frames(spark, sf).withColumn("v", F.when(F.col("conf") >= 0.3, F.col("hz")))
    return series.running_median(f, "v", "track", ["t", "ord"]).select("ord", thousandths(F.col("smoothed")).alias("smoothed"))


@query(f"""WITH {POINTS}, o AS (SELECT track, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY track), w AS (SELECT track, unnest(range(CAST(floor((t1 - t0) / 86400) AS INT))) AS w FROM o),
c AS (SELECT p.track, CAST(floor((p.t - t0) / 86400) AS INT) AS w, note, count(*) AS c FROM points p JOIN o USING (track) GROUP BY ALL),
b AS (SELECT track, w, sum(c) AS n, max(c) AS top, arg_max(note, (c, note)) AS note FROM c GROUP BY ALL),
l AS (SELECT w.track, w.w, CASE WHEN coalesce(n, 0) / 4.0 < 0.125 THEN 'unvoiced' WHEN coalesce(n, 0) / 4.0 >= 0.5 AND top / n >= 0.6 THEN note END AS label FROM w LEFT JOIN b ON w.track = b.track AND w.w = b.w)
SELECT track, CAST(w AS INT) AS w, label FROM l WHERE label IS NOT NULL""")
def A46_window_labels(spark, sf):
    spans = frames(spark, sf).groupBy("track").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("duration"))
    p = points(spark, sf).join(spans.select("track", "t0"), "track").withColumn("t", F.col("t") - F.col("t0"))
    return series.windows_labelled(p, spans, 86400.0, 4, 0.5, 0.6)


@query(f"WITH {FRAMES}, d AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t, ord) AS d FROM frames) SELECT track, CAST(round(coalesce(60 / median(d) FILTER (d > 1e-6), 100) * 1e6) AS BIGINT) AS bpm FROM d GROUP BY track")
def A45_median_tempo(spark, sf):
    d = frames(spark, sf).withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("track").orderBy("t", "ord")))
    return d.groupBy("track").agg(F.round(F.coalesce(60 / F.median(F.when(F.col("d") > 1e-6, F.col("d"))), F.lit(100.0)) * 1e6).cast("long").alias("bpm"))


@query(f"""WITH {FRAMES}, x AS (SELECT track, hz, row_number() OVER (PARTITION BY track ORDER BY t, ord) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM frames),
b AS (SELECT track, CAST(floor(i * 8 / n) AS BIGINT) AS bucket, avg(hz) AS m, min(hz) AS lo, max(hz) AS hi FROM x GROUP BY ALL)
SELECT track, bucket, CAST(round(m * 1000) AS BIGINT) AS mean, lo, hi, CAST(round((m - min(m) OVER (PARTITION BY track)) / CASE max(m) OVER (PARTITION BY track) - min(m) OVER (PARTITION BY track) WHEN 0 THEN 1 ELSE max(m) OVER (PARTITION BY track) - min(m) OVER (PARTITION BY track) END * 1000) AS BIGINT) AS scaled FROM b""")
def A42_A43_A44_downsample(spark, sf):
    w = Window.partitionBy("track")
    x = frames(spark, sf).withColumn("i", F.row_number().over(w.orderBy("t", "ord")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    b = x.groupBy("track", F.floor(F.col("i") * 8 / F.col("n")).alias("bucket")).agg(F.avg("hz").alias("m"), F.min("hz").alias("lo"), F.max("hz").alias("hi"))
    low, span = F.min("m").over(w), F.max("m").over(w) - F.min("m").over(w)
    return b.select("track", "bucket", thousandths(F.col("m")).alias("mean"), "lo", "hi", thousandths((F.col("m") - low) / F.when(span == 0, 1.0).otherwise(span)).alias("scaled"))


@query("""WITH b AS (SELECT user_id AS u, epoch_us(ts) / 1e6 AS s, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e, event_id FROM events), q AS (SELECT u, min(s) + 100000 * k AS x, k FROM b, (SELECT unnest(range(20)) AS k) GROUP BY u, k)
SELECT q.u, CAST(k AS INT) AS k, b.event_id FROM q JOIN b ON q.u = b.u AND s <= x AND x < e""")
def J20_active_at(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("u"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), "event_id")
    q = e.groupBy("u").agg(F.min("s").alias("s0")).select("u", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "s0").select("u", (F.col("s0") + 100000 * F.col("k")).alias("x"), "k")
    # the latest start at or before each probe: both sorted together by one shuffle on the key, no range join
    w = Window.partitionBy("u").orderBy("x", "kind", "event_id")
    starts = e.select("u", F.col("s").alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("k"), "event_id")
    probes = q.select("u", "x", F.lit(1).alias("kind"), "k", F.lit(None).cast("long").alias("event_id"))
    last = F.max("x").over(Window.partitionBy("u", "kind"))
    both = starts.unionByName(probes).withColumn("top", F.when(F.col("kind") == 0, last)).withColumn("at", F.last("event_id", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.max("top").over(Window.partitionBy("u")))
    return both.where((F.col("kind") == 1) & F.col("at").isNotNull() & (F.col("x") < F.col("end"))).select("u", "k", F.col("at").alias("event_id"))


@query(f"""WITH {FRAMES} SELECT ord, CAST(round(CASE WHEN hz > 0 THEN (69 + 12 * log2(hz / 440)) * 100 END * 1000) AS BIGINT) AS cents, CAST(round({FOLD.format(hz="hz", ref="440.0")} * 1000) AS BIGINT) AS folded,
 CAST(floor(greatest(0, 100 - abs(1200 * log2(hz / 440))) + 0.5) AS BIGINT) AS score, abs(1200 * log2(hz / 440)) <= 15 AS in_tune FROM frames WHERE hz > 0""")
def F_M_pitch_functions(spark, sf):
    hz = F.col("hz")
    a = pitch.accuracy(hz, F.lit(440.0))
    return frames(spark, sf).where("hz > 0").select("ord", thousandths(pitch.hz_to_cents(hz)).alias("cents"), thousandths(pitch.octave_folded_cents(hz, F.lit(440.0))).alias("folded"), a["score"].alias("score"), a["in_tune"].alias("in_tune"))


@query(f"WITH {FRAMES}, m AS (SELECT *, median(hz) OVER (PARTITION BY track) AS m FROM frames) SELECT track, count(*) AS n FROM m WHERE hz >= m - 20 GROUP BY track")
def P19_quiet_segments(spark, sf):
    f = frames(spark, sf)
    m = stats.quantiles(f, "hz", ["track"], [0.5]).select("track", F.col("p50").alias("m"))
    return f.join(m, "track").where("hz >= m - 20").groupBy("track").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS} SELECT track, note, count(*) AS n, CASE WHEN count(*) >= 3 THEN CAST(round(median(cents) * 1000) AS BIGINT) END AS median FROM points GROUP BY ALL")
def P18_A34_supported_median(spark, sf):
    g = points(spark, sf).groupBy("track", "note").agg(F.count(F.lit(1)).alias("n"), F.median("cents").alias("m"))
    return g.select("track", "note", "n", thousandths(stats.supported(F.col("m"), F.col("n"), 3)).alias("median"))
