"""Inventory, transcripts, splits and text scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import archive, series, stats

from . import query
from .data import table, thousandths


@query("""SELECT doc_id, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)""")
def W6_duplicate_flags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return archive.first_seen_flags(d, "sha", "doc_id", "doc_id").select("doc_id", "duplicate_of")


@query("""WITH g AS (SELECT sha256(text) AS s, count(*) AS n FROM documents GROUP BY 1) SELECT count(*) AS files, count(DISTINCT sha256(text)) AS unique_files, (SELECT count(*) FROM g WHERE n > 1) AS groups, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g WHERE n > 1) AS extra, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents""")
def A22_A23_inventory_summary(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    return g.agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("unique_files"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("extra"), F.sum("c").alias("chars"))


@query("""SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations""")
def J2_W5_carry_forward(spark, sf):
    c = table(spark, sf, "conversations")
    return archive.carry_forward(c, F.col("role") == "user", F.col("turn"), ["conv_id"], ["turn"], "header").select("conv_id", "turn", "header")


@query("""WITH c AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS nw FROM conversations), i AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, isl ORDER BY turn) AS rn FROM i) SELECT conv_id, turn FROM r WHERE rn <= 2""")
def W4_repeats_capped(spark, sf):
    i = series.islands(table(spark, sf, "conversations"), "conv_id", ["turn"], "role")
    return archive.top_per_key(i, ["conv_id", "island"], [F.col("turn")], 2).select("conv_id", "turn")


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(text, '[♪♫♬]+', ' ', 'g'), '[\[\(]\s*(?:music|applause|laughter|singing|instrumental|foreign|noise)\s*[\]\)]', ' ', 'gi'), '\s+', ' ', 'g'))"""


@query(f"""WITH t AS (SELECT conv_id, turn, {CLEAN} AS x FROM conversations), f AS (SELECT * FROM t WHERE x <> ''), g AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY conv_id ORDER BY turn) = x THEN 0 ELSE 1 END AS nw FROM f),
i AS (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, isl ORDER BY turn) AS rn FROM i)
SELECT conv_id, sha256(string_agg(x, ' ' ORDER BY turn)) AS transcript FROM r WHERE rn <= 2 GROUP BY conv_id""")
def F_S6_F_S7_transcript(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", text.clean_segment(F.col("text")).alias("x")).where("x <> ''")
    kept = archive.top_per_key(series.islands(c, "conv_id", ["turn"], "x"), ["conv_id", "island"], [F.col("turn")], 2)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda s: s["x"])
    return kept.groupBy("conv_id").agg(F.sha2(F.array_join(lines, " "), 256).alias("transcript"))


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents WHERE lang = 'en') SELECT word, n FROM (SELECT word, count(*) AS n FROM w WHERE len(word) > 2 GROUP BY word) ORDER BY n DESC, word LIMIT 30""")
def A36_word_count(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en'")
    w = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0))).alias("word")).where(F.length("word") > 2)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(30)


@query("""WITH s AS (SELECT conv_id, sum(len(text)) AS d, sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS a, count(*) AS n, count(*) FILTER (role = 'assistant') AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(round(a / d * 1000) AS BIGINT) AS ratio, k / n >= 0.5 AS majority FROM s WHERE d > 0""")
def A32_A33_votes(spark, sf):
    hit, size = F.col("role") == "assistant", F.length("text")
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(size).alias("d"), F.sum(F.when(hit, size).otherwise(0)).alias("a"), F.avg(hit.cast("int")).alias("v")).where("d > 0")
    return g.select("conv_id", F.round(F.col("a") / F.col("d") * 1000).cast("long").alias("ratio"), (F.col("v") >= 0.5).alias("majority"))


@query("""SELECT p_partkey, CASE WHEN CAST(('0x' || substr(sha1(p_name), 1, 2)) AS INT) >= 0 THEN list_reduce(list_prepend(0, list_transform(string_split(sha1(p_name), ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, b: (a * 16 + b) % 100) END AS pct FROM part""")
def F_S15_hash_split(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.hash_percent(F.col("p_name")).cast("long").alias("pct"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha1(CAST(p_partkey AS VARCHAR)), p_partkey) - 1 AS i, count(*) OVER () AS n FROM part) SELECT p_partkey, CASE WHEN i < round_even(n * 0.8, 0) THEN 'train' WHEN i < round_even(n * 0.9, 0) THEN 'val' ELSE 'test' END AS split FROM r""")
def W9_ranked_split(spark, sf):
    """Two boundaries instead of a rank for each row: the rows at 80 and 90 % of the hash order are found by a top-n."""
    p = table(spark, sf, "part").select("p_partkey", F.struct(F.sha1(F.col("p_partkey").cast("string")).alias("h"), "p_partkey").alias("o"))
    n = p.count()
    row = lambda q, c: p.orderBy("o").offset(int(round(n * q))).limit(1).select(F.col("o").alias(c))
    cuts = row(0.8, "a").join(F.broadcast(row(0.9, "b")))
    return p.join(F.broadcast(cuts)).select("p_partkey", F.when(F.col("o") < F.col("a"), "train").when(F.col("o") < F.col("b"), "val").otherwise("test").alias("split"))  # one row is sent


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 7 = 0 AND rn <= 21")
def W12_stride_sample(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").withColumn("rn", F.row_number().over(w)).where("(rn - 1) % 7 = 0 and rn <= 21").select("doc_id")


@query("SELECT l_orderkey, arg_max(l_linenumber, (CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE -l_linenumber END)) AS line FROM lineitem GROUP BY l_orderkey")
def W13_preferred_copy(spark, sf):
    """The last preferred row wins, else the first row."""
    hit, n = F.col("l_returnflag") == "A", F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by(n, F.struct(hit.cast("int"), F.when(hit, n).otherwise(-n))).alias("line"))


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset FROM lineitem")
def W14_running_onset(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("onset"))


@query("SELECT event_id, CAST(k AS INT) AS win FROM (SELECT event_id, event_id // 8 - 1 AS a FROM events), (SELECT unnest([0, 1]) AS d) x, LATERAL (SELECT a + d AS k) WHERE k >= 0")
def W16_overlapping_windows(spark, sf):
    """Windows of 16 with a hop of 8: each sample lies in two."""
    e = table(spark, sf, "events").withColumn("last", F.floor(F.col("event_id") / 8))
    return e.select("event_id", F.explode(F.sequence((F.col("last") - 1).cast("int"), F.col("last").cast("int"))).alias("win")).where("win >= 0")


@query("SELECT user_id, CAST(chunk AS BIGINT) AS chunk, n FROM (SELECT user_id, floor((rn - 1) / 30) AS chunk, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL) WHERE n >= 10")
def W19_chunks(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("chunk", F.floor((F.row_number().over(w) - 1) / 30))
    return e.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n <= 20 OR (i >= (n - 20) // 2 AND i < (n - 20) // 2 + 20)")
def W20_centred_excerpt(spark, sf):
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events").withColumn("i", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    at = F.floor((F.col("n") - 20) / 2)
    return e.where((F.col("n") <= 20) | ((F.col("i") >= at) & (F.col("i") < at + 20))).select("event_id")


@query("SELECT user_id, ts, event_id, lag(event_type, CAST(event_id % 4 AS INT)) OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) AS shifted FROM events WHERE event_id % 4 <> 9")
def W18_delay_pattern(spark, sf):
    """Each of four books is delayed by its number."""
    e = table(spark, sf, "events").withColumn("book", F.col("event_id") % 4)
    w = Window.partitionBy("user_id", "book").orderBy("ts", "event_id")
    shifted = F.coalesce(*(F.when(F.col("book") == k, F.lag("event_type", k).over(w) if k else F.col("event_type")) for k in range(4)))
    return e.select("user_id", "ts", "event_id", shifted.alias("shifted"))


@query(r"""SELECT page_id, lower(regexp_extract(regexp_extract(string_split(url, '?')[1], '([^/]*)$', 1), '[^.].*?(\.[^.]*)$', 1)) AS ext, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM pages""")
def F_S11_url_scalars(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.file_extension(F.col("url")).alias("ext"), text.safe_name(F.col("url")).alias("safe"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, substr(CAST(year(o_orderdate) AS VARCHAR), 1, 3) || '0s' AS decade, CASE WHEN year(o_orderdate) < 1995 THEN 'early' ELSE 'late' END AS era FROM o""")
def F_S13_F_D4_F_D5_formats(spark, sf):
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", text.clock(F.col("o_totalprice") / 10).alias("clock"), text.decade(y).alias("decade"), F.when(y < 1995, "early").otherwise("late").alias("era"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 15 DAY AS expires, CAST(date_trunc('day', o_orderdate) AS DATE) AS day FROM orders")
def F_D1_F_D2_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 15 DAYS")).alias("expires"), F.to_date("o_orderdate").alias("day"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) <= 2")
def O5_most_common(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return archive.top_per_key(c, "user_id", [F.desc("n"), F.col("event_type")], 2).select("user_id", "event_type", "n")


@query("SELECT doc_id, url FROM documents LEFT JOIN pages ON doc_id = page_id")
def J1_by_ordinal(spark, sf):
    """The ordinal was given at ingest and is a column; it is never made up by a window over all rows."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return table(spark, sf, "documents").select("doc_id").join(p, "doc_id", "left")


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
SELECT a.user_id, CAST(a.i AS INT) AS i, a.event_id AS click, b.event_id AS view FROM e a JOIN e b ON a.user_id = b.user_id AND a.i = b.i WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def J24_by_position(spark, sf):
    """Each user's n-th click beside the n-th view."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").where("event_type in ('click', 'view')").withColumn("i", F.row_number().over(w))
    side = lambda t: e.where(F.col("event_type") == t).select("user_id", "i", F.col("event_id").alias(t))
    return side("click").join(side("view"), ["user_id", "i"])


@query("""SELECT d.doc_id, coalesce(CASE WHEN trim(p.url) <> '' THEN p.url END, d.source) AS title, CASE WHEN p.page_id IS NOT NULL THEN 'catalog' ELSE 'filename' END AS source FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
def J5_override(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"))
    return archive.override(d, p, "doc_id", ["title"])


@query("""SELECT d.doc_id, l.quality, p.url IS NOT NULL AS has_page, e.label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def J3_J6_four_way_join(spark, sf):
    d, lab, p, e = (table(spark, sf, t) for t in ("documents", "labels", "pages", "embeddings"))
    p = p.select(F.col("page_id").alias("doc_id"), F.lit(True).alias("hit"))
    e = e.select(F.col("vec_id").alias("doc_id"), "label")
    return d.select("doc_id").join(lab.select("doc_id", "quality"), "doc_id", "left").join(p, "doc_id", "left").join(e, "doc_id", "left").select("doc_id", "quality", F.coalesce("hit", F.lit(False)).alias("has_page"), "label")


@query("""SELECT user_id, CAST(sum(value) FILTER (event_type = 'click') * 100 AS BIGINT) // 100 - CAST(sum(value) FILTER (event_type = 'view') * 100 AS BIGINT) // 100 AS delta FROM events GROUP BY user_id""")
def J27_pivot_compare(spark, sf):
    p = table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.call_function("div", F.rint(F.sum("value") * 100).cast("long"), F.lit(100)))
    return p.select("user_id", (F.col("click") - F.col("view")).alias("delta"))


def runs_of_events(spark, sf):
    """Two runs over the same tracks, each of which lost a third of the frames: median of each track and degree."""
    e = table(spark, sf, "events")
    median = lambda rows, name: stats.quantiles(rows, "value", ["user_id", "event_type"], [0.5]).withColumnRenamed("p50", name)
    return median(e.where("event_id % 3 <> 0 AND value < 80"), "value"), median(e.where("event_id % 3 <> 1 AND value > 20"), "value")


RUNS = """a AS (SELECT user_id, event_type, median(value) AS v FROM events WHERE event_id % 3 <> 0 AND value < 80 GROUP BY ALL), b AS (SELECT user_id, event_type, median(value) AS v FROM events WHERE event_id % 3 <> 1 AND value > 20 GROUP BY ALL),
ab AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.v AS a, b.v AS b, CASE WHEN b.user_id IS NULL THEN 'left' WHEN a.user_id IS NULL THEN 'right' ELSE 'both' END AS side
 FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)"""


@query(f"WITH {RUNS} SELECT user_id, event_type, side, CAST(round((a - b) * 1000) AS BIGINT) AS delta FROM ab")
def J27_two_runs(spark, sf):
    """Every track and degree that either run has, with the side that lacks it."""
    c = archive.compared(*runs_of_events(spark, sf), ["user_id", "event_type"], "value")
    return c.select("user_id", "event_type", "side", thousandths(F.col("delta")).alias("delta"))


@query(f"WITH {RUNS} SELECT count(*) FILTER (side = 'both') AS n_both, count(*) FILTER (side = 'left') AS only_left, count(*) FILTER (side = 'right') AS only_right, CAST(round(median(abs(a - b)) * 1000) AS BIGINT) AS median_delta FROM ab")
def J27_two_runs_summary(spark, sf):
    c = archive.compared_summary(archive.compared(*runs_of_events(spark, sf), ["user_id", "event_type"], "value"))
    return c.select("n_both", "only_left", "only_right", thousandths(F.col("median_delta")).alias("median_delta"))


@query("""SELECT 'joined' AS what, NULL AS o_custkey, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c_acctbal > 0
UNION ALL SELECT 'missed', o_custkey, count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0) GROUP BY o_custkey""")
def J16_report_of_misses(spark, sf):
    """Orders of customers in the black; each other customer is reported with the orders that were passed over."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    joined, missed = archive.joined_with_misses(o, c, "o_custkey")
    return joined.agg(F.lit("joined").alias("what"), F.lit(None).cast("long").alias("o_custkey"), F.count(F.lit(1)).alias("n")).unionByName(missed.select(F.lit("missed").alias("what"), F.col("o_custkey").cast("long"), "n"))


@query("SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id HAVING count(*) >= 3 ORDER BY conv_id LIMIT 10")
def O10_head(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    return g.where("n >= 3").orderBy("conv_id").limit(10)


@query("SELECT doc_id, source, n_chars FROM documents")
def P4_lite_view(spark, sf):
    return table(spark, sf, "documents").drop("text", "lang")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, list_sort(list({'timeSec': event_id, 'noteLabel': event_type}))[1].noteLabel AS first FROM events GROUP BY user_id")
def P5_renamed_in_arrays(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("time_sec"), F.col("event_type").alias("note_label")))).alias("a"))
    camel = F.transform("a", lambda x: F.struct(x["time_sec"].alias("timeSec"), x["note_label"].alias("noteLabel")))
    return g.select("user_id", F.size("a").cast("long").alias("n"), camel[0]["noteLabel"].alias("first"))


@query("SELECT p_partkey, coalesce(nullif(trim(p_type), ''), 'unknown') AS kind, CAST(substr(p_brand, 7) AS INT) - 1 AS code FROM part")
def P22_P24_encode_and_default(spark, sf):
    """A brand that the code book does not hold ends the query."""
    p = table(spark, sf, "part")
    code = text.encoded(F.col("p_brand"), [f"Brand#{k}" for k in range(1, 26)])
    return p.select("p_partkey", F.coalesce(text.blank_to_null(F.col("p_type")), F.lit("unknown")).alias("kind"), code.alias("code"))


@query("SELECT o_orderpriority AS k, count(*) AS n, CAST(sum(o_totalprice) FILTER (o_orderstatus = 'F') AS BIGINT) // 1000 AS f, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def A37_A52_dataset_summary(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.floor(F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))).cast("long") / 1000).alias("f"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT split, count(*) AS clips, CAST(sum(p_size) AS BIGINT) AS seconds FROM (SELECT p_size, CASE WHEN p_partkey % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM part) GROUP BY split")
def A24_A48_split_summary(spark, sf):
    p = table(spark, sf, "part").withColumn("split", F.when(F.col("p_partkey") % 10 < 8, "train").otherwise("val"))
    return p.groupBy("split").agg(F.count(F.lit(1)).alias("clips"), F.sum("p_size").alias("seconds"))


@query("""SELECT l_suppkey, count(*) AS n, median(l_quantity) AS med, CAST(round(1000 * avg(l_quantity) FILTER (i <= 12)) AS BIGINT) AS head, CAST(round(1000 * avg(l_quantity) FILTER (i > n - 10)) AS BIGINT) AS tail
FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) WHERE i > 2 GROUP BY l_suppkey""")
def A50_A55_warm_up_summary(spark, sf):
    """Each supplier's lines stand for a training log; the first two steps are left out."""
    w = Window.partitionBy("l_suppkey")
    x = table(spark, sf, "lineitem").withColumn("i", F.row_number().over(w.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))).withColumn("n", F.count(F.lit(1)).over(w)).where("i > 2")
    mean = lambda c: F.round(1000 * F.avg(F.when(c, F.col("l_quantity")))).cast("long")
    return x.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.median("l_quantity").alias("med"), mean(F.col("i") <= 12).alias("head"), mean(F.col("i") > F.col("n") - 10).alias("tail"))


@query("SELECT count(*) AS n, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, CAST(round(quantile_cont(o_totalprice, 0.1)) AS BIGINT) AS p10, CAST(round(quantile_cont(o_totalprice, 0.9)) AS BIGINT) AS p90, count(*) FILTER (o_totalprice < 15000) AS below FROM orders")
def A10_A11_corpus_report(spark, sf):
    o = table(spark, sf, "orders")
    y, p = F.year("o_orderdate"), F.percentile("o_totalprice", F.array(F.lit(0.1), F.lit(0.9)))
    return o.agg(F.count(F.lit(1)).alias("n"), F.min(y).cast("long").alias("first"), F.max(y).cast("long").alias("last"), F.round(p[0]).cast("long").alias("p10"), F.round(p[1]).cast("long").alias("p90"), F.count_if(F.col("o_totalprice") < 15000).alias("below"))


@query("""WITH f AS (SELECT l_suppkey AS file, l_partkey // 10 AS fr, 10 * log10(avg(l_quantity * l_quantity)) AS db, max(l_quantity) AS peak FROM lineitem GROUP BY ALL)
SELECT file, CAST(round(1000 * (quantile_cont(db, 0.9) - quantile_cont(db, 0.1))) AS BIGINT) AS snr, max(peak) AS peak, count(*) FILTER (db < 20) AS quiet FROM f GROUP BY file""")
def A13_frame_quality(spark, sf):
    f = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.floor(F.col("l_partkey") / 10).alias("fr")).agg((10 * F.log10(F.avg(F.col("l_quantity") * F.col("l_quantity")))).alias("db"), F.max("l_quantity").alias("peak"))
    rest = f.groupBy("file").agg(F.max("peak").alias("peak"), F.count_if(F.col("db") < 20).alias("quiet"))
    both = stats.beside(rest, stats.quantiles(f, "db", ["file"], [0.1, 0.9]), ["file"])
    return both.select("file", F.round(1000 * (F.col("p90") - F.col("p10"))).cast("long").alias("snr"), "peak", "quiet")


@query("SELECT o_clerk, n FROM (SELECT CAST(o_custkey % 11 AS BIGINT) AS o_clerk, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c_acctbal > 0 GROUP BY 1)")
def J4_J10_J16_inner_and_misses(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_acctbal > 0")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy((F.col("o_custkey") % 11).alias("o_clerk")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p.p_partkey, l.quality, d.lang FROM part p SEMI JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) x ON p.p_partkey = x.l_partkey LEFT JOIN labels l ON l.doc_id = p.p_partkey LEFT JOIN documents d ON d.doc_id = p.p_partkey")
def J14_J17_semi_then_lookup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))
    have = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("doc_id"))
    out = p.join(have, "doc_id", "left_semi").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "left")
    return out.withColumnRenamed("doc_id", "p_partkey")


@query("""WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id + 3 AS b FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT a AS x FROM e UNION SELECT b FROM e), p AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT x, x AS y FROM n UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x) SELECT x AS node, min(y) AS root FROM r GROUP BY x""")
def J23_tied_groups(spark, sf):
    """Ties chain short groups of glyphs; labels spread along them until nothing changes."""
    from fathom.operators.graph import closure

    d = table(spark, sf, "documents").where("doc_id % 4 <> 0")
    return closure(d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 3).alias("b")))


@query("""WITH c(page_id, url) AS (SELECT page_id, url FROM pages), d AS (SELECT doc_id, source FROM documents) SELECT d.doc_id, CASE WHEN c.page_id IS NOT NULL THEN c.url WHEN l.doc_id IS NOT NULL THEN 'label' || l.quality END AS meta
FROM d LEFT JOIN c ON c.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def J25_priority_of_matches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    c = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url", F.lit(True).alias("c"))
    lab = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("l"))
    return d.join(c, "doc_id", "left").join(lab, "doc_id", "left").select("doc_id", F.when(F.col("c"), F.col("url")).when(F.col("l"), F.concat(F.lit("label"), F.col("quality").cast("string"))).alias("meta"))


@query("SELECT d.doc_id, l.toxic, CASE WHEN l.toxic IS NOT NULL THEN CAST(l.toxic = d.doc_id % 2 AS INT) END AS hit FROM documents d LEFT JOIN labels l USING (doc_id)")
def J26_J28_nullable_match(spark, sf):
    j = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return j.select("doc_id", "toxic", F.when(F.col("toxic").isNotNull(), (F.col("toxic") == F.col("doc_id") % 2).cast("int")).alias("hit"))


@query("SELECT c_custkey FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 7)")
def J29_P20_secondary_key(spark, sf):
    c = table(spark, sf, "customer")
    key = c.where("c_custkey = 7").select("c_name")
    return c.join(key, "c_name", "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY sha1(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 20)")
def O11_seeded_sample(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '5-LOW'")
    return o.orderBy(F.sha1(F.col("o_orderkey").cast("string")), "o_orderkey").limit(20).select("o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least FROM orders GROUP BY o_custkey")
def O12_argmax_argmin(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"), F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("least"))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place FROM orders")
def O7_owner_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("place"))


@query("SELECT c_custkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def U2_union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("kind")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("kind")))


@query("SELECT conv_id, len(list_intersect(list(DISTINCT role), ['user', 'system'])) AS n FROM conversations GROUP BY conv_id")
def U4_set_intersection(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return g.select("conv_id", F.size(F.array_intersect("r", F.array(F.lit("user"), F.lit("system")))).cast("long").alias("n"))


@query("SELECT o_orderkey, CAST(date_diff('second', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS BIGINT) AS gap FROM orders")
def W11_first_difference(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", (s - F.lag(s).over(w)).alias("gap"))


@query(r"""WITH p AS (SELECT p_partkey, 'track_' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') || '_Side_b_Track_' || p_size || '_x.mp3' AS f, 'Side A. Track ' || p_size || ': Song, 19' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS t FROM part)
SELECT p_partkey, 'track_' || regexp_extract(f, '^track_(\d{4})_', 1) AS track_id, 'B' AS side, p_size AS position, 'Song, 19' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS song, 1900 + p_size % 100 AS year FROM p JOIN part USING (p_partkey)""")
def F_S1_F_S2_F_S3_names(spark, sf):
    p = table(spark, sf, "part")
    size, two = F.col("p_size").cast("string"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    f = F.concat(F.lit("track_"), F.lpad(F.col("p_partkey").cast("string"), 4, "0"), F.lit("_Side_b_Track_"), size, F.lit("_x.mp3"))
    t = F.concat(F.lit("Side A. Track "), size, F.lit(": Song, 19"), two)
    n, c = text.track_name(f), text.catalog_title(t)
    return p.select("p_partkey", n["track_id"].alias("track_id"), n["side"].alias("side"), n["position"].alias("position"), c["song_title"].alias("song"), text.trailing_date(t)["year"].alias("year"))


@query("SELECT p_partkey, CASE WHEN len(list_filter(['tin', 'steel', 'brass'], lambda k: contains(lower(p_type), k))) = 1 THEN upper(list_filter(['tin', 'steel', 'brass'], lambda k: contains(lower(p_type), k))[1][1]) || list_filter(['tin', 'steel', 'brass'], lambda k: contains(lower(p_type), k))[1][2:] END AS genre FROM part")
def F_S4_only_keyword(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.only_keyword(F.col("p_type"), ["tin", "steel", "brass"]).alias("genre"))


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page FROM events")
def F_A8_json(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.get_json_object("props", "$.page").alias("page"))
