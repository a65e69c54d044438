"""Vectors, clusterings and classification figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import vectors
from fathom.operators import ivf, neighbours, stats
from fathom.sources import writers

from . import query
from .data import table, thousandths

COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NEAR = f"""near AS (SELECT a.vec_id AS id, b.vec_id AS other, a.label, b.label AS other_label, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


LISTS, ROUNDS, PROBES = 16, 4, 12


def unit_sql(v: str) -> str:
    return f"CASE WHEN list_sum(list_transform({v}, lambda x: x * x)) > 0 THEN list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y)))) ELSE {v} END"


def kmeans_sql(k: int, rounds: int) -> str:
    """The clustering of ivf.kmeans: rows(vec_id, label, list, rk) has each row's lists, the closest first."""
    ctes = [
        f"units AS MATERIALIZED (SELECT vec_id, label, {unit_sql('v')} AS u FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS INT) AS list, u AS c FROM units QUALIFY list < {k})",
    ]
    near = "row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(u, c), 9) DESC, list)"
    for r in range(rounds):
        ctes += [
            f"a{r} AS MATERIALIZED (SELECT u, list FROM units, c{r} QUALIFY {near} = 1)",
            f"s{r} AS MATERIALIZED (SELECT list, list(x ORDER BY pos) AS s FROM (SELECT list, pos, sum(x) AS x FROM (SELECT list, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM a{r}) GROUP BY ALL) GROUP BY list)",
            f"c{r + 1} AS MATERIALIZED (SELECT o.list, CASE WHEN s IS NULL THEN c ELSE {unit_sql('s')} END AS c FROM c{r} o LEFT JOIN s{r} USING (list))",
        ]
    return ", ".join(ctes) + f", rows AS MATERIALIZED (SELECT vec_id, label, list, {near} AS rk FROM units, c{rounds})"


PROBED = f"""{kmeans_sql(LISTS, ROUNDS)}, found AS (SELECT q.vec_id AS id, b.vec_id AS other, list_dot_product(q.u, b.u) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.u, b.u), 9) DESC, b.vec_id) AS rank
 FROM units q JOIN rows p ON p.vec_id = q.vec_id AND p.rk <= {PROBES} JOIN rows l ON l.rk = 1 AND l.list = p.list JOIN units b ON b.vec_id = l.vec_id AND b.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)"""


def clustered(spark, sf, k, rounds=ROUNDS):
    """key and list of each row."""
    e = table(spark, sf, "embeddings")
    return ivf.assigned(e, ivf.kmeans(e, k, rounds)).select("key", F.col("lists")[0].alias("list"))


def indexed(spark, sf):
    """An inverted-file index of all rows, and the stated queries."""
    e, path = table(spark, sf, "embeddings"), writers.scratch(spark)
    ivf.build(e, ivf.kmeans(e, LISTS, ROUNDS), path)
    return path, e.where("vec_id % 50 = 0")


@query(f"WITH {PROBED} SELECT id, CAST(rank AS INT) AS rank, other, CAST(round(sim * 1000) AS BIGINT) AS sim FROM found WHERE rank <= 10")
def S14_X10_probe_lists(spark, sf):
    """The 12 of 16 lists closest to a query are searched."""
    path, q = indexed(spark, sf)
    return ivf.probe(spark, path, q, 10, PROBES).select("id", "rank", "other", thousandths(F.col("sim")).alias("sim"))


@query(f"WITH {NEAR} SELECT id, CAST(rank AS INT) AS rank, other, CAST(round(sim * 1000) AS BIGINT) AS sim FROM near WHERE rank <= 10")
def S14_probe_all_lists(spark, sf):
    """All lists: the exact search."""
    path, q = indexed(spark, sf)
    return ivf.probe(spark, path, q, 10, None).select("id", "rank", "other", thousandths(F.col("sim")).alias("sim"))


@query(f"WITH {PROBED}, {NEAR} SELECT count(*) AS n, CAST(round(1000 * avg(CASE WHEN f.id IS NOT NULL THEN 1 ELSE 0 END)) AS BIGINT) AS recall, avg(CASE WHEN f.id IS NOT NULL THEN 1 ELSE 0 END) >= 0.9 AS enough FROM (SELECT * FROM near WHERE rank <= 10) n LEFT JOIN (SELECT * FROM found WHERE rank <= 10) f ON f.id = n.id AND f.other = n.other")
def S14_recall(spark, sf):
    """Of the ten nearest of each query, how many the probed lists have."""
    path, q = indexed(spark, sf)
    got = ivf.recall(ivf.probe(spark, path, q, 10, PROBES), neighbours.nearest(table(spark, sf, "embeddings"), q, 10))
    return got.select("n", thousandths(F.col("recall")).alias("recall"), (F.col("recall") >= 0.9).alias("enough"))


@query(f"WITH {NEAR.replace(' WHERE a.vec_id % 50 = 0', '')} SELECT id, CAST(rank AS INT) AS rank, other, CAST(round(sim * 1000) AS BIGINT) AS sim FROM near WHERE rank <= 5")
def O4_neighbours_of_all(spark, sf):
    """Every row is a query."""
    e = table(spark, sf, "embeddings")
    return neighbours.nearest(e, e, 5).select("id", "rank", "other", thousandths(F.col("sim")).alias("sim"))


def neighbours_of(spark, sf, k=3):
    """Neighbours of a stated set of queries, every row whose id is divisible by 50."""
    e = table(spark, sf, "embeddings")
    return neighbours.nearest(e, e.where("vec_id % 50 = 0"), k)


@query(f"WITH {NEAR} SELECT id, CAST(rank AS INT) AS rank, other, CAST(round(sim * 1000) AS BIGINT) AS sim FROM near WHERE rank <= 3")
def W15_O3_nearest(spark, sf):
    return neighbours_of(spark, sf).select("id", "rank", "other", thousandths(F.col("sim")).alias("sim"))


@query(f"""WITH {NEAR} SELECT count(*) AS n, count(*) FILTER (label = other_label) AS same, (SELECT CAST(round(1000 * sum(s * (s - 1)) / (sum(s) * (sum(s) - 1))) AS BIGINT) FROM (SELECT count(*) AS s FROM embeddings GROUP BY label)) AS chance,
CAST(round(list_sort(list(sim))[len(list(sim)) // 2 + 1] * 1000) AS BIGINT) AS upper FROM near WHERE rank = 1""")
def A27_J15_leakage_audit(spark, sf):
    label = table(spark, sf, "embeddings").select("vec_id", "label")
    own, other = label.toDF("id", "own"), label.toDF("other", "its")
    near = neighbours_of(spark, sf, 1)
    top = near.join(own, "id").join(other, "other").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") == F.col("its")).alias("same"))
    top = top.join(F.broadcast(stats.upper_median(near, "sim").select(thousandths(F.col("sim")).alias("upper"))))  # one row is sent
    s = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("s"))
    chance = s.agg(F.round(1000 * F.sum(F.col("s") * (F.col("s") - 1)) / (F.sum("s") * (F.sum("s") - 1))).cast("long").alias("chance"))
    return top.join(F.broadcast(chance))  # one row is sent


@query(f"""WITH {kmeans_sql(8, ROUNDS)}, c AS (SELECT label AS a, list AS b, count(*) AS n FROM rows WHERE rk = 1 GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), sa AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT CAST(t AS BIGINT) AS n, CAST(round(1e6 * (i - sa.s * sb.s / (t * (t - 1) / 2)) / ((sa.s + sb.s) / 2 - sa.s * sb.s / (t * (t - 1) / 2))) AS BIGINT) AS ari FROM x, sa, sb""")
def A26_adjusted_rand(spark, sf):
    """The clusters against the labels."""
    label = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("a"))
    e = clustered(spark, sf, 8).select("key", F.col("list").alias("b")).join(label, "key")
    return stats.adjusted_rand(e, "a", "b").select("n", F.round(F.col("ari") * 1e6).cast("long").alias("ari"))


@query(f"WITH {kmeans_sql(8, ROUNDS)} SELECT k AS cluster, count(e.vec_id) AS n FROM (SELECT CAST(unnest(range(12)) AS INT) AS k) LEFT JOIN (SELECT * FROM rows WHERE rk = 1) e ON e.list = k GROUP BY k")
def A25_cluster_sizes(spark, sf):
    """Sizes of eight clusters; numbers beyond them have none."""
    e = clustered(spark, sf, 8).groupBy(F.col("list").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(12).select(F.col("id").cast("int").alias("cluster")).join(e, "cluster", "left").fillna(0, ["n"])


@query("SELECT a.quality, b.toxic, count(l.doc_id) AS n FROM (SELECT unnest([0, 1]) AS quality) a CROSS JOIN (SELECT unnest([0, 1]) AS toxic) b LEFT JOIN labels l ON l.quality = a.quality AND l.toxic = b.toxic GROUP BY ALL")
def A28_confusion(spark, sf):
    return stats.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("""WITH c AS (SELECT k AS label, count(*) FILTER (quality = k) AS support, count(*) FILTER (toxic = k) AS predicted, count(*) FILTER (quality = k AND toxic = k) AS tp FROM labels, (SELECT unnest([0, 1]) AS k) GROUP BY k)
SELECT label, support, CAST(round(1000 * tp / nullif(predicted, 0)) AS BIGINT) AS precision, CAST(round(1000 * tp / nullif(support, 0)) AS BIGINT) AS recall, CAST(round(1000 * CASE WHEN tp > 0 THEN 2.0 * tp / (predicted + support) WHEN support > 0 AND predicted > 0 THEN 0 END) AS BIGINT) AS f1 FROM c""")
def A29_class_metrics(spark, sf):
    m = stats.class_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return m.select("label", "support", *(thousandths(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT CAST(round(1000 * coalesce(avg(CASE WHEN abs(c_acctbal / 100) <= 50 THEN 1 ELSE 0 END), 0)) AS BIGINT) AS accuracy FROM customer")
def A30_within_tolerance(spark, sf):
    c = table(spark, sf, "customer")
    return c.agg(thousandths(F.coalesce(F.avg((F.abs(F.col("c_acctbal") / 100) <= 50).cast("int")), F.lit(0.0))).alias("accuracy"))


@query("SELECT vec_id, CAST(round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * 1000) AS BIGINT) AS norm, len(embedding) = 64 AS ok, CAST(round(list_transform(embedding, lambda x: CAST(x AS DOUBLE))[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * 1000) AS BIGINT) AS first FROM embeddings")
def F_M13_P23_vectors(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", thousandths(vectors.norm(v)).alias("norm"), vectors.valid(v, 64).alias("ok"), thousandths(vectors.normalised(v)[0]).alias("first"))


@query("SELECT label, CAST(pos - 1 AS INT) AS pos, CAST(round(avg(x) * 1000) AS BIGINT) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def A51_mean_pool(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(thousandths(F.avg(F.col("x").cast("double"))).alias("mean"))
