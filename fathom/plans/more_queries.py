"""Further scalars, summaries and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import pitch, text, vectors
from fathom.operators import loudness, series

from . import query
from .data import FRAMES, frames, table, thousandths
from .series_queries import PCS, pitch_classes

_K = ", ".join(f"({m}, {k}, {w})" for m, x in enumerate(series.KEYS) for k, w in enumerate(x))


@query(f"""WITH {PCS}, tpl(m, k, w) AS (VALUES {_K}), h AS (SELECT track, pc, coalesce(weight, 0) AS weight FROM (SELECT DISTINCT track FROM pcs) CROSS JOIN (SELECT unnest(range(12)) AS pc) LEFT JOIN pcs USING (track, pc)),
c AS (SELECT track, t, m, corr(weight, CAST(w AS DOUBLE)) AS r FROM h, tpl, (SELECT unnest(range(12)) AS t) WHERE (k + t) % 12 = pc GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(r, 9) DESC, t, m) AS rn FROM c)
SELECT track, CAST(t AS INT) AS tonic, m AS mode, CAST(round(r * 1000) AS BIGINT) AS score FROM b WHERE rn = 1""")
def A18_key_estimate(spark, sf):
    return series.tonic(pitch_classes(spark, sf), templates=series.KEYS).withColumn("score", thousandths(F.col("score")))


@query("""SELECT l_returnflag AS grp, count(*) AS n, CAST(round(avg(l_discount) * 1000) AS BIGINT) AS mean, CAST(round(median(l_tax) * 1000) AS BIGINT) AS median, CAST(round(stddev_pop(l_quantity) * 1000) AS BIGINT) AS std,
 CAST(round(avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) * 1000) AS BIGINT) AS rate FROM lineitem GROUP BY 1""")
def A20_A21_group_summary(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("grp")).agg(F.count(F.lit(1)).alias("n"), thousandths(F.avg("l_discount")).alias("mean"), thousandths(F.median("l_tax")).alias("median"), thousandths(F.stddev_pop("l_quantity")).alias("std"), thousandths(F.avg((F.col("l_linestatus") == "O").cast("int"))).alias("rate"))


@query(f"""WITH {FRAMES}, e AS (SELECT f.*, event_type FROM frames f JOIN events ON event_id = ord), b AS (SELECT track, t AS b, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS i, lead(t) OVER (PARTITION BY track ORDER BY t) - t AS up, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS back FROM (SELECT DISTINCT track, t FROM e WHERE event_type = 'click')),
s AS (SELECT track, b, i, coalesce(up, back) AS step FROM b WHERE up IS NOT NULL OR back IS NOT NULL), q AS (SELECT track, ord, t FROM e WHERE event_type = 'view'),
a AS (SELECT q.track, ord, t, arg_max(s, b) FILTER (b <= t) AS m, arg_min(s, b) AS first FROM q JOIN s ON q.track = s.track GROUP BY ALL)
SELECT track, ord, CAST(round((coalesce(m, first).i + (t - coalesce(m, first).b) / coalesce(m, first).step) * 1000) AS BIGINT) AS beat FROM a""")
def J21_times_to_beats(spark, sf):
    f = frames(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("ord"), "event_type"), "ord")
    beats = f.where("event_type = 'click'").select("track", F.col("t").alias("b")).distinct()
    enough = beats.groupBy("track").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    times = f.where("event_type = 'view'").select("track", "ord", "t")
    return series.beat_position(times, beats.join(enough.select("track"), "track"), "track", "ord").withColumn("beat", thousandths(F.col("beat")))


@query()
def A31_word_error_rate(spark, sf):
    """Each turn against the turn before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w))
    return c.select("conv_id", "turn", F.round(text.word_error_rate(F.col("before"), F.col("text")) * 1000).cast("long").alias("wer"))


@query("SELECT user_id, event_type, count(*) AS n, CAST(round(avg(value) * 1000) AS BIGINT) AS mean, CAST(round(count(*) / sum(count(*)) OVER (PARTITION BY user_id) * 1000) AS BIGINT) AS share FROM events GROUP BY user_id, event_type")
def A35_dominance_by_count(spark, sf):
    from pyspark.sql import Window

    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), thousandths(F.avg("value")).alias("mean"))
    return g.withColumn("share", thousandths(F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))))


@query(f"WITH {FRAMES} SELECT track, count(*) FILTER (hz > 60 AND hz < 400 AND conf > 0.5) AS voiced, count(*) FILTER (conf >= 0.8 AND hz > 0) AS gated FROM frames GROUP BY track")
def P9_P10_masks(spark, sf):
    """The gate keeps its bounds, the voiced mask excludes them."""
    f = frames(spark, sf)
    return f.groupBy("track").agg(F.count_if((F.col("hz") > 60) & (F.col("hz") < 400) & (F.col("conf") > 0.5)).alias("voiced"), F.count_if((F.col("conf") >= 0.8) & (F.col("hz") > 0)).alias("gated"))


@query("""SELECT c_custkey, lower(trim(c_name)) AS email, coalesce(nullif(trim(c_mktsegment), ''), 'untitled') AS title, substr(sha1(c_name), 1, 24) AS id24, substr(sha256(c_name), 1, 16) AS id16, printf('cassette_%03d', c_nationkey) AS split_key FROM customer""")
def F_S11_F_S12_F_S14_keys(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.lower(F.trim("c_name")).alias("email"), F.coalesce(text.blank_to_null(F.col("c_mktsegment")), F.lit("untitled")).alias("title"), F.substring(F.sha1("c_name"), 1, 24).alias("id24"), F.substring(F.sha2("c_name", 256), 1, 16).alias("id16"), F.format_string("cassette_%03d", "c_nationkey").alias("split_key"))


@query("""SELECT p_partkey, p_type || ', traditional song, ' || CASE WHEN p_size * 4 < 80 THEN 'slow' WHEN p_size * 4 <= 120 THEN 'moderate' ELSE 'lively' END || ' at ' || p_size * 4 || ' BPM, pentatonic melody rooted on ' ||
 ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][p_partkey % 12 + 1] || ', 1970s archival recording' AS caption, CAST(p_partkey % 12 AS INT) AS tonic FROM part""")
def F_S10_F_M18_caption(spark, sf):
    p = table(spark, sf, "part")
    name = F.element_at(F.array(*map(F.lit, pitch.NOTE_NAMES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    cap = p.withColumn("caption", text.caption(F.col("p_type"), F.col("p_size") * 4, name, F.lit(1975)))
    return cap.select("p_partkey", "caption", text.tonic_in_caption(F.col("caption"), pitch.NOTE_NAMES).alias("tonic"))


@query("""SELECT event_id, value > 200 OR event_id % 10 / 4.0 > 2.0 OR -value / 300 < -1.0 AS hallucinated, CAST(round(least(1, greatest(0, exp(-value / 100))) * 1000) AS BIGINT) AS confidence FROM events""")
def F_M8_F_M9_segments(spark, sf):
    v = F.col("value")
    bad = text.looks_hallucinated(F.when(v > 200, 0.7).otherwise(0.1), F.when(F.col("event_id") % 10 / 4.0 > 2.0, 3.0), -v / 300)
    return table(spark, sf, "events").select("event_id", bad.alias("hallucinated"), thousandths(text.segment_confidence(-v / 100)).alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(20 * log10(greatest(l_discount, 1e-9)) * 1000) AS BIGINT) AS dbfs, CAST(round(greatest(0.25, round_even(l_tax * 10 / 0.25, 0) * 0.25) * 100) AS BIGINT) AS snapped, CAST(round(l_quantity / greatest(max(l_quantity) OVER (PARTITION BY l_orderkey), 1e-9) * 1000) AS BIGINT) AS loudness FROM lineitem""")
def F_M10_F_M17_F_M21_levels(spark, sf):
    from pyspark.sql import Window

    top = F.greatest(F.max("l_quantity").over(Window.partitionBy("l_orderkey")), F.lit(1e-9))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", thousandths(20 * F.log10(F.greatest("l_discount", F.lit(1e-9)))).alias("dbfs"),
        F.round(F.greatest(F.lit(0.25), F.bround(F.col("l_tax") * 10 / 0.25) * 0.25) * 100).cast("long").alias("snapped"), thousandths(F.col("l_quantity") / top).alias("loudness"),
    )


@query("""SELECT vec_id, CAST(list_sum(list_transform(embedding[5:] || embedding[:4], lambda x, i: CAST(round(x * 1000) AS BIGINT) * i)) AS BIGINT) AS rolled, len(embedding) AS n, CAST(round(1000 * list_aggregate(CAST(embedding AS DOUBLE[]), 'quantile_cont', 0.9)) AS BIGINT) AS p90 FROM embeddings""")
def F_A1_F_A5_arrays(spark, sf):
    v = F.col("embedding")
    rolled = F.concat(F.slice(v, 5, F.size(v)), F.slice(v, 1, 4))
    s = F.aggregate(F.transform(rolled, lambda x, i: F.round(x * F.lit(1000).cast("float")).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", s.alias("rolled"), F.size(v).cast("long").alias("n"), F.round(1000 * vectors.percentile(v, 0.9)).cast("long").alias("p90"))


@query("SELECT event_id, CAST(coalesce(try_cast(CASE WHEN event_id % 9 = 0 THEN 'no date' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP), TIMESTAMP '1970-01-01') AS DATE) AS day FROM events")
def F_D3_F_D6_revived_dates(spark, sf):
    t = F.when(F.col("event_id") % 9 == 0, "no date").otherwise(F.col("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", F.to_date(F.coalesce(F.try_to_timestamp(t), F.to_timestamp(F.lit("1970-01-01")))).alias("day"))


@query("SELECT o_orderkey, CAST(to_json({'id': o_orderkey, 'status': o_orderstatus}) AS VARCHAR) AS js, CAST(json_extract_string(to_json({'id': o_orderkey}), '$.id') AS BIGINT) AS back FROM orders")
def F_A8_json_round_trip(spark, sf):
    js = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf, "orders").select("o_orderkey", js.alias("js"), F.from_json(js, "id long")["id"].alias("back"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS top FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn <= 3 GROUP BY user_id")
def F_A4_F_A7_counter_to_map(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type", "n"))), 1, 3)
    g = c.groupBy("user_id").agg(F.map_from_entries(F.transform(top, lambda x: F.struct(x["event_type"], x["n"]))).alias("m"))
    return g.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("top"))


@query("SELECT event_id, CAST(10 * greatest(0, least(100, event_id % 50 / 40.0 * 100) - CASE WHEN event_id % 7 = 0 THEN 10 ELSE 0 END) AS BIGINT) AS quality, CASE WHEN value >= 300 THEN 'high' WHEN value >= 100 THEN 'mid' ELSE 'low' END AS tier FROM events")
def F_M11_F_M15_scores(spark, sf):
    v, e = F.col("value"), F.col("event_id")
    quality = text.quality_score((e % 50).cast("double"), F.when(e % 7 == 0, 0.0).otherwise(-6.0))
    return table(spark, sf, "events").select("event_id", F.round(10 * quality).cast("long").alias("quality"), F.when(v >= 300, "high").when(v >= 100, "mid").otherwise("low").alias("tier"))


RATE, TAPS = 4000, 700


def impulse_response() -> list[float]:
    """What the two filters make of a single sample: their sum with the samples is the same filter without recursion."""
    m, out = loudness.Weighted(RATE), []
    for k in range(TAPS):
        x = float(k == 0)
        for (b0, b1, b2, a1, a2), z in zip(m.coefficients, m.states, strict=True):
            y = b0 * x + z[0]
            z[0], z[1] = b1 * x - a1 * y + z[1], b2 * x - a2 * y
            x = y
        out.append(x)
    return out


@query(f"""WITH s AS (SELECT l_linenumber % 2 AS k, row_number() OVER (PARTITION BY l_linenumber % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, (CAST(l_quantity AS DOUBLE) - 25.5) / 25 AS x FROM lineitem),
h AS (SELECT unnest(range({TAPS})) AS j, unnest({impulse_response()}) AS h), y AS (SELECT k, i + j AS i, sum(x * h) AS y FROM s, h GROUP BY ALL), n AS (SELECT k, count(*) AS n, max(abs(x)) AS top FROM s GROUP BY k),
st AS (SELECT y.k, i // 400 AS step, sum(y * y) / 400 AS e FROM y JOIN n ON n.k = y.k WHERE i < n // 400 * 400 GROUP BY ALL), b AS (SELECT k, z, -0.691 + 10 * log10(z) AS l FROM (SELECT k, sum(e) OVER w / 4 AS z, count(*) OVER w AS c FROM st WINDOW w AS (PARTITION BY k ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE c = 4),
g AS (SELECT k, -10.691 + 10 * log10(avg(z)) AS gate FROM b WHERE l >= -70 GROUP BY k), r AS (SELECT b.k, -0.691 + 10 * log10(avg(z)) AS l FROM b JOIN g ON g.k = b.k WHERE l >= -70 AND l > gate GROUP BY b.k),
f AS (SELECT n.k, l + 20 * log10(0.99 / top) AS l, 0.99 / top AS first FROM n LEFT JOIN r ON n.k = r.k)
SELECT k, CAST(round(l * 1000) AS BIGINT) AS loudness, CAST(round(first * least(coalesce(pow(10, (-14 - l) / 20), 1), 1) * 1000000) AS BIGINT) AS gain, coalesce(pow(10, (-14 - l) / 20), 1) > 1 AS limited FROM f""")
def F_M20_loudness_gain(spark, sf):
    """Quantities as samples of two channels."""
    li = table(spark, sf, "lineitem")
    x = li.select((F.col("l_linenumber") % 2).alias("k"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("i"), ((F.col("l_quantity").cast("double") - 25.5) / 25).alias("x"))
    g = loudness.gains(x, "k", RATE)
    return g.select("k", thousandths(F.col("loudness")).alias("loudness"), F.round(F.col("gain") * 1e6).cast("long").alias("gain"), "limited")
