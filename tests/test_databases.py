"""Tables and collections in an embedded database."""

import uuid

import pytest
from pyspark.sql import functions as F

from fathom.sources import databases


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_partitioned_read_and_upsert(spark, url):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("n"), F.concat(F.lit("name "), "id").alias("name"))
    for _ in range(2):  # a second run changes nothing
        databases.upsert(rows, url, "items", ["id"])
        got = databases.table(spark, url, "items", "id", 4)
        assert got.rdd.getNumPartitions() == 4
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    changed = spark.createDataFrame([(5, 70, "five"), (5, 70, "five"), (2000, 1, None)], "id long, n long, name string")
    databases.upsert(changed, url, "items", ["id"])
    got = {r.id: (r.n, r.name) for r in databases.table(spark, url, "items", "id", 3).collect()}
    assert len(got) == 1001 and got[5] == (70, "five") and got[2000] == (1, None) and got[6] == (6, "name 6")
    pushed = databases.table(spark, url, "items", "id", 3).where("n = 70")
    assert pushed.count() == 1 and "PushedFilters: [*IsNotNull(n), *EqualTo(n,70)]" in pushed._jdf.queryExecution().toString()


def test_failed_upsert_leaves_the_table_alone(spark, url):
    rows = spark.range(10).select("id", F.lit("a").alias("name"))
    databases.upsert(rows, url, "items", ["id"], types="name VARCHAR(3)")
    with pytest.raises(Exception, match="(?i)trunc"):
        databases.upsert(spark.createDataFrame([(1, "b"), (2, "too long")], "id long, name string"), url, "items", ["id"], types="name VARCHAR(20)")
    assert {r.name for r in databases.table(spark, url, "items", "id", 2).collect()} == {"a"}


def test_collection(spark, url):
    rows = spark.createDataFrame([(1, "a", (2.5, ["x", "y"])), (2, None, None)], "id long, title string, about struct<score: double, tags: array<string>>")
    databases.save_collection(rows, url, "songs")
    databases.save_collection(rows.where("id = 1").withColumn("title", F.lit("b")), url, "songs")
    got = databases.collection(spark, url, "songs", "title STRING, about STRUCT<score: DOUBLE, tags: ARRAY<STRING>>")
    assert sorted((r.id, r.title, r.about and (r.about.score, r.about.tags), r._corrupt) for r in got.collect()) == [(1, "b", (2.5, ["x", "y"]), None), (2, None, None, None)]


def test_empty_table(spark, url):
    rows = spark.createDataFrame([], "id long, n long")
    databases.upsert(rows, url, "items", ["id"])
    assert databases.table(spark, url, "items", "id", 4).collect() == []
