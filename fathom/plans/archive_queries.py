"""Relational queries over recordings, users, collections and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import archive, search

from . import query
from .data import RECORDINGS, recordings, table


@query(f"""WITH {RECORDINGS} SELECT id, title, artist_name AS artist, genre, to_json({{'transcript': nullif(transcript, ''), 'chars': n_chars}}) IS NOT NULL AS has_ai, nullif(transcript, '') IS NOT NULL AS has_transcript FROM rec WHERE deleted_at IS NULL""")
def P1_public_projection(spark, sf):
    r = archive.live(recordings(spark, sf))
    ai = F.struct(F.nullif("transcript", F.lit("")).alias("transcript"), F.col("n_chars").alias("chars"))
    return r.select("id", "title", F.struct(F.col("artist_name").alias("name")).alias("artist"), "genre", F.to_json(ai).alias("json"), ai.alias("ai")).select(
        "id", "title", F.col("artist.name").alias("artist"), "genre", F.col("json").isNotNull().alias("has_ai"), F.col("ai.transcript").isNotNull().alias("has_transcript")
    )


@query(f"WITH {RECORDINGS} SELECT id, title, status, n_chars, CAST(NULL AS VARCHAR) AS pitch FROM rec WHERE status = 'published' AND deleted_at IS NULL")
def P2_research_export(spark, sf, include_pitch: bool = False):
    r = archive.live(recordings(spark, sf)).where("status = 'published'")
    return r.select("id", "title", "status", "n_chars", F.when(F.lit(include_pitch), F.col("transcript")).alias("pitch"))


@query(f"WITH {RECORDINGS} SELECT id, concat_ws(' ', nullif(title, ''), nullif(artist_name, '')) AS text FROM rec")
def P3_search_projection(spark, sf):
    return recordings(spark, sf).select("id", F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("artist_name", F.lit(""))).alias("text"))


@query(f"WITH {RECORDINGS} SELECT id FROM rec WHERE deleted_at IS NULL AND status = 'published' AND genre = 'en' AND artist_name = 'src1'")
def P6_P7_facets(spark, sf):
    return archive.facets(archive.live(recordings(spark, sf)).where("status = 'published'"), genre="en", era=None, artist_name="src1").select("id")


@query(f"WITH {RECORDINGS} SELECT status, count(*) AS n FROM rec WHERE deleted_at IS NULL GROUP BY status")
def P8_moderation_queue(spark, sf):
    return archive.live(recordings(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderpriority <> '1-URGENT' OR o_orderpriority IS NULL) AND o_custkey IN (1, 5, 9, 13, 42) ")
def P11_not_duplicate_in_list(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(~F.contains("o_orderpriority", F.lit("1-URGENT")) & F.col("o_custkey").isin(1, 5, 9, 13, 42)).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal > 0 AND (c_custkey % 3 = 0 OR c_custkey % 7 > 2) AS active FROM customer")
def P13_expiry(spark, sf):
    """Keys that expire: a third never does (null), others by a number that stands for the time."""
    c = table(spark, sf, "customer").withColumn("expires", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 7))
    return c.select("c_custkey", ((F.col("c_acctbal") > 0) & (F.col("expires").isNull() | (F.col("expires") > 2))).alias("active"))


@query(f"WITH {RECORDINGS} SELECT id FROM rec WHERE status = 'published' OR artist_name = 'src3'")
def P14_row_access(spark, sf):
    return recordings(spark, sf).where((F.col("status") == "published") | (F.col("artist_name") == "src3")).select("id")


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('BuildinG')")
def P15_case_insensitive_key(spark, sf):
    return table(spark, sf, "customer").where(F.lower("c_mktsegment") == F.lower(F.lit("BuildinG"))).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 2, 3) OR s_name IN ('Supplier#7', 'Supplier#000000008')")
def P16_either_key(spark, sf):
    s = table(spark, sf, "supplier")
    return s.where(F.col("s_suppkey").isin(1, 2, 3) | F.col("s_name").isin("Supplier#7", "Supplier#000000008")).select("s_suppkey")


@query(f"WITH {RECORDINGS} SELECT id, list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN title = '' THEN 'title' END, CASE WHEN status = 'draft' THEN 'draft' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM rec WHERE n_chars < 300 OR title = '' OR status = 'draft'")
def P17_P21_rules(spark, sf):
    rules = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.col("title") == "", "title"), F.when(F.col("status") == "draft", "draft")))
    r = recordings(spark, sf).withColumn("e", rules).where(F.size("e") > 0)
    return r.select("id", F.concat(F.lit("["), F.array_join("e", ", "), F.lit("]")).alias("errors"))


@query(f"WITH {RECORDINGS} SELECT id FROM rec WHERE contains(lower(title), 'an') OR contains(lower(artist_name), 'an')")
def P25_substring_filter(spark, sf):
    return archive.contains_any(recordings(spark, sf), " An", ["title", "artist_name"]).select("id")


@query(f"""WITH {RECORDINGS}, c AS (SELECT id, 0 AS p FROM rec WHERE id IN (11, 12) AND status = 'none' UNION ALL SELECT id, 1 FROM rec WHERE genre = 'de' AND id <> 4)
SELECT id FROM c WHERE p = (SELECT min(p) FROM c) ORDER BY id LIMIT 6""")
def P26_fallback_relation(spark, sf):
    r = recordings(spark, sf)
    both = r.where("id in (11, 12) and status = 'none'").select("id", F.lit(0).alias("p")).unionByName(r.where("genre = 'de' and id <> 4").select("id", F.lit(1).alias("p")))
    return both.join(F.broadcast(both.agg(F.min("p").alias("least"))), F.col("p") == F.col("least")).orderBy("id").limit(6).select("id")  # one row is sent


@query(f"""WITH {RECORDINGS}, f AS (SELECT * FROM rec WHERE deleted_at IS NULL AND status = 'published')
SELECT id, created, (SELECT count(*) FROM f) AS total, 20 < (SELECT count(*) FROM f) AS has_more FROM f ORDER BY created DESC, id LIMIT 10 OFFSET 10""")
def O1_newest_first_page(spark, sf):
    r = archive.live(recordings(spark, sf)).where("status = 'published'").select("id", "created")
    return archive.page(r, [F.desc("created"), F.col("id")], 2, 10)


@query(f"""WITH {RECORDINGS}, t AS (SELECT *, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(transcript), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS b FROM rec),
s AS (SELECT id, created, list_sum(list_transform(['the', 'de', 'the'], lambda q: 6.0 * len(list_filter(a, lambda x: x = q)) + 1.5 * len(list_filter(b, lambda x: x = q)))) AS score FROM t)
SELECT id, CAST(score * 10 AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, created DESC, id LIMIT 25""")
def O2_F_S9_ranked_search(spark, sf):
    r = recordings(spark, sf)
    hits = search.search(r, "The de, THE", created="created", weights={"title": 6.0, "transcript": 1.5})
    return hits.select("id", (F.col("score") * 10).cast("long").alias("score")).limit(25)


@query(f"""WITH {RECORDINGS}, p AS (SELECT id, 6.0 AS w, unnest(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM rec UNION ALL SELECT id, 1.5, unnest(string_split_regex(lower(transcript), '[^\\p{{L}}\\p{{N}}]+')) FROM rec)
SELECT term, count(DISTINCT id) AS docs, CAST(sum(w) * 2 AS BIGINT) AS weight FROM p WHERE term <> '' GROUP BY term HAVING count(DISTINCT id) >= 20""")
def F_S8_postings(spark, sf):
    p = search.postings(recordings(spark, sf), weights={"title": 6.0, "transcript": 1.5})
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), (F.sum("weight") * 2).cast("long").alias("weight")).where("docs >= 20")


IDS = "ids AS (SELECT (k * 37 % 150) AS id, k AS pos FROM (SELECT unnest(range(24)) AS k))"


def ids(spark):
    return spark.range(24).select((F.col("id") * 37 % 150).alias("k"), F.col("id").alias("pos")).withColumnRenamed("k", "id")


@query(f"WITH {RECORDINGS}, {IDS} SELECT id, pos FROM ids JOIN rec USING (id) WHERE status = 'published' ORDER BY pos LIMIT 6")
def J7_J8_hydrate(spark, sf):
    return archive.hydrate(ids(spark), recordings(spark, sf), "id", limit=6).select("id", "pos")


@query(f"WITH {RECORDINGS}, {IDS} SELECT id, pos FROM ids JOIN rec USING (id) WHERE status = 'published' AND pos < 6 ORDER BY pos LIMIT 2")
def O6_overfetch_then_filter(spark, sf):
    return archive.overfetch(ids(spark), recordings(spark, sf), "id", limit=2).select("id", "pos")


@query("SELECT o_custkey, count(*) AS items, count(*) FILTER (o_orderstatus = 'F') AS visible FROM orders GROUP BY o_custkey")
def J9_collection_contents(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("o_orderstatus") == "F").alias("visible"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def A38_A39_counts_joined(spark, sf):
    return archive.counts_joined(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "n")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def J11_include(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'institution' ELSE c_mktsegment END AS plan FROM customer")
def J13_exists_overrides(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_custkey").distinct()
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.when(F.col("o_custkey").isNotNull(), "institution").otherwise(F.col("c_mktsegment")).alias("plan"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def J30_referential_guard(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 5000")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def J18_not_yet_done(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return archive.not_yet(table(spark, sf, "orders"), done, "o_orderkey").select("o_orderkey")


@query("SELECT artist, n FROM (SELECT source AS artist, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY source) ORDER BY n DESC, f LIMIT 5")
def A40_featured_artists(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("artist")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("f"))
    return d.orderBy(F.desc("n"), "f").limit(5).select("artist", "n")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_partkey % 20 AS lesson FROM lineitem WHERE l_returnflag = 'A'), m AS (SELECT unnest(range(0, 20, 2)) AS lesson)
SELECT l_orderkey, count(*) AS done, CAST(floor(100 * count(*) / 10.0 + 0.5) AS BIGINT) AS pct FROM d JOIN m USING (lesson) GROUP BY l_orderkey""")
def A41_module_progress(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", (F.col("l_partkey") % 20).alias("lesson"))
    module = spark.range(0, 20, 2).withColumnRenamed("id", "lesson")
    g = done.join(module, "lesson", "left_semi").groupBy("l_orderkey").agg(F.count_distinct("lesson").alias("done"))
    return g.withColumn("pct", F.floor(100 * F.col("done") / 10.0 + 0.5))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) AS INT) AS seq FROM orders")
def A47_daily_sequence(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderdate", "o_orderkey")).alias("seq"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def O13_latest_per_user(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT o_orderpriority, n, list_position(['5-LOW', '3-MEDIUM', '1-URGENT'], o_orderpriority) AS pos FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT')")
def O8_custom_order(spark, sf):
    order = F.array(*map(F.lit, ("5-LOW", "3-MEDIUM", "1-URGENT")))
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pos", F.array_position(order, F.col("o_orderpriority")).cast("int")).where("pos > 0").orderBy("pos")


@query("SELECT event_id, user_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 40) WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1")
def O9_bounded_dedupe(spark, sf):
    e = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(40)
    return e.where("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id")


CHANGES = "ch AS (SELECT user_id AS k, event_id AS seq, ts AS created, event_type AS v, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events)"


def changes(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.col("ts").alias("created"), F.col("event_type").alias("v"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("p"))


@query(f"WITH {CHANGES} SELECT k, arg_min(created, seq) AS created, arg_max(v, seq) AS v, max(seq) AS seq FROM ch GROUP BY k")
def U6_U15_upsert(spark, sf):
    c = changes(spark, sf).drop("p")
    return archive.upsert(c.where("seq % 2 = 0"), c.where("seq % 2 = 1"), "k", "seq", ["created"])


@query(f"WITH {CHANGES} SELECT k, arg_max(v, seq) AS v, arg_max(p, seq) FILTER (p IS NOT NULL) AS p FROM ch GROUP BY k")
def U7_U8_U9_patch(spark, sf):
    return archive.patch(changes(spark, sf), "k", "seq", ["v", "p"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT l_orderkey FROM lineitem l WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_custkey % 5 = 0)")
def U11_cascade(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    gone = o.where("o_custkey % 5 = 0").select("o_orderkey")
    return o.where("o_custkey % 5 <> 0").select("o_orderkey").unionByName(li.join(gone, "o_orderkey", "left_anti"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'revoked' ELSE o_orderstatus END AS status, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 1 END, 2) AS deleted FROM orders")
def U10_U12_conditional_update(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000), "revoked").otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce(F.when(F.col("o_orderkey") % 3 == 0, 1), F.lit(2)).alias("deleted"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def U1_U3_set_operations(spark, sf):
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    known = c.select(F.col("c_nationkey").alias("k")).unionByName(s.select(F.col("s_nationkey").alias("k"))).distinct()
    return known.join(n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("k")), "k", "left_anti")


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def U5_idempotent_insert(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'amount:' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) WHEN 'error' THEN 'failed' ELSE event_type END AS outcome FROM events""")
def U14_tagged_union(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", F.when(kind == "purchase", F.concat(F.lit("amount:"), F.floor("value").cast("string"))).when(kind == "error", "failed").otherwise(kind).alias("outcome"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice >= 300000) AS high, count(*) FILTER (o_totalprice >= 100000 AND o_totalprice < 300000) AS mid, count(*) FILTER (o_totalprice < 100000) AS low FROM orders GROUP BY 1")
def A53_A54_bucket_counts(spark, sf):
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(p >= 300000).alias("high"), F.count_if((p >= 100000) & (p < 300000)).alias("mid"), F.count_if(p < 100000).alias("low"))
