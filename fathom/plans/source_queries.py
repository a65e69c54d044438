"""Sources and sinks: tables are written and read again; also retries, paging by key and first writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import text
from fathom.operators import archive
from fathom.sources import readers, writers

from . import query
from .data import table


@query("SELECT c_custkey, c_name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer")
def S4_S8_csv(spark, sf):
    path = writers.scratch(spark)
    writers.csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    got = readers.csv(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")
    return got.select("c_custkey", "c_name", F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 < 8")
def S7_json_lines_split(spark, sf):
    path = writers.scratch(spark)
    o = table(spark, sf, "orders")
    o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("val").alias("split")).write.json(path)
    return readers.json_lines(spark, path, "o_orderkey BIGINT, o_orderstatus STRING, split STRING", "train").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def S9_dataset_sinks(spark, sf):
    """The flat file has the nested field as a dotted column; the file without private columns has no balance."""
    path = writers.scratch(spark)
    c = table(spark, sf, "customer").select("c_custkey", F.struct(F.col("c_mktsegment").alias("segment")).alias("about"), "c_acctbal")
    writers.dataset(c, path, ["c_acctbal"])
    flat = readers.csv(spark, f"{path}/flat", "c_custkey BIGINT, `about.segment` STRING, c_acctbal DOUBLE")
    lite = spark.read.schema("c_custkey BIGINT, c_acctbal DOUBLE").json(f"{path}/lite").where("c_acctbal IS NULL")
    return flat.join(lite.select("c_custkey"), "c_custkey").select("c_custkey", F.col("`about.segment`").alias("segment"))


@query("SELECT event_type AS stage, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def S10_ledger(spark, sf):
    """Two versions are saved; the last one counts."""
    path = writers.scratch(spark)
    e = table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("track_id"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("done").alias("status"))
    writers.save_ledger(e.where("status = 'failed'"), path)
    writers.save_ledger(e, path)
    return readers.ledger(spark, path).where("status = 'done'").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, len(embedding) AS n, CAST(round(1000 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))) AS BIGINT) AS total FROM embeddings WHERE vec_id % 2 = 0")
def S14_S15_snapshot(spark, sf):
    v = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select("vec_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return writers.snapshot(v, writers.scratch(spark)).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(1000 * total).cast("long").alias("total"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '' ELSE 'positive' END AS errors FROM customer WHERE c_custkey % 5 <> 0")
def S26_ingest(spark, sf):
    c = table(spark, sf, "customer")
    new, bad = writers.ingest(c, c.where("c_custkey % 5 = 0"), "c_custkey", {"positive": F.col("c_acctbal") > 0})
    return new.select("c_custkey", F.lit("").alias("errors")).unionByName(bad.select("c_custkey", F.array_join("errors", ",").alias("errors")))


@query("SELECT event_id AS step, CASE WHEN event_id <= 100 THEN 'old' ELSE 'new' END AS run FROM events WHERE event_id <= 100 OR event_id > 100")
def S27_resumed_log(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("step"))
    return writers.resumed_log(e.withColumn("run", F.lit("old")), e.withColumn("run", F.lit("new")), 100)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_id % 6 >= 5 THEN 'failed' ELSE 'retry' END AS action, CASE WHEN event_type <> 'error' AND event_id % 6 < 5 THEN CAST(30 * power(2, event_id % 6) AS BIGINT) END AS wait FROM events")
def ST10_retries(spark, sf):
    e = table(spark, sf, "events")
    next_ = archive.next_try((F.col("event_id") % 6).cast("int"), F.col("event_type") == "error", most=5, base=30)
    return e.select("event_id", next_["action"].alias("action"), next_["wait"].alias("wait"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first FROM events GROUP BY user_id")
def A52_first_write_wins(spark, sf):
    return archive.first_write(table(spark, sf, "events"), "user_id", "event_id").select("user_id", F.col("event_type").alias("first"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 60")
def O14_pages_by_key(spark, sf):
    """Three pages of twenty, each asked for by the last row of the one before."""
    o, out, last = table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), None, None
    for _ in range(3):
        page = archive.page_after(o, "o_orderdate", "o_orderkey", last, 20)
        last = page.orderBy("o_orderdate", F.desc("o_orderkey")).first()  # one row
        out = page if out is None else out.unionByName(page)
    return out.select("o_orderkey")


@query("SELECT p_partkey, 'a' || p_partkey AS artist, p_type AS title FROM part WHERE NOT contains(p_type, '_') AND NOT contains(p_type, '.')")
def F_S5_name_parts(spark, sf):
    p = table(spark, sf, "part").where(~F.contains("p_type", F.lit("_")) & ~F.contains("p_type", F.lit(".")))
    n = text.name_parts(F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(".mp3")))
    return p.select("p_partkey", n["artist"].alias("artist"), n["title"].alias("title"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE trim(p_type) END AS who FROM part")
def F_S16_attribution(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.attribution(F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.concat("p_type", F.lit(", 1971-05-01")))).alias("who"))
