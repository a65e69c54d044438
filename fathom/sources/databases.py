"""Database tables and document collections over JDBC: read in ranges of a key, written by upserts that may run again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def execute(spark: SparkSession, url: str, *statements: str) -> None:
    """Runs statements in one transaction, on the driver."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for s in statements:
            statement.execute(s)
        connection.commit()
    finally:
        connection.rollback()
        connection.close()


def table(spark: SparkSession, url: str, name: str, key: str, partitions: int, **options: str) -> DataFrame:
    """A table in ranges of a numeric key, so that executors read side by side. The bounds are asked for first; they part the
    rows evenly where keys are even, and no row is left out where they are not. Filters on columns go to the database."""
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    low, high = reader().option("query", f'SELECT min("{key}") AS low, max("{key}") AS high FROM {name}').load().first()
    if low is None or low == high:
        return reader().option("dbtable", name).load()
    return reader().options(dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions).load()


def upsert(df: DataFrame, url: str, name: str, keys: list[str], types: str = "", partitions: int = 8, **options: str) -> None:
    """Rows whose keys are in the table replace those there, the others are added; made anew if there is no such table.

    Tasks write side by side to a table of this run; one statement then merges that into the target, so readers see all of the
    rows or none, and a run that died and is run again ends the same. Of rows with equal keys one is taken. types: columns
    whose type is to be another than Spark's choice, as in "name VARCHAR(64)".
    """
    spark, staged = df.sparkSession, f"{name}_{uuid.uuid4().hex[:12]}"
    rows = df.dropDuplicates(keys)
    writer = lambda d: d.write.format("jdbc").options(url=url, **({"createTableColumnTypes": types} if types else {}), **options)
    own = T.StructType([T.StructField(f.name, f.dataType, f.name not in keys) for f in df.schema])  # later rows may have nulls
    writer(spark.createDataFrame([], own)).option("dbtable", name).mode("ignore").save()
    writer(rows.coalesce(partitions)).option("dbtable", staged).mode("overwrite").save()
    q = lambda c: f'"{c}"'
    rest = [c for c in df.columns if c not in keys]
    update = "WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{q(c)} = s.{q(c)}" for c in rest) if rest else ""
    insert = f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, df.columns))}) VALUES ({', '.join('s.' + q(c) for c in df.columns)})"
    on = " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    try:
        execute(spark, url, f"MERGE INTO {name} AS t USING {staged} AS s ON {on} {update} {insert}")
    finally:
        execute(spark, url, f"DROP TABLE {staged}")


def collection(spark: SparkSession, url: str, name: str, schema: str, key: str = "id", partitions: int = 8, **options: str) -> DataFrame:
    """A collection of JSON documents (key, doc) as rows of the stated schema; _corrupt has what can't be read."""
    docs = table(spark, url, name, key, partitions, **options)
    parsed = F.from_json("doc", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return docs.select(key, parsed.alias("d")).select(key, "d.*")


def save_collection(df: DataFrame, url: str, name: str, key: str = "id", **options: str) -> None:
    """Rows as JSON documents, by upsert on the key; nested fields stay nested."""
    rest = [c for c in df.columns if c != key]
    upsert(df.select(key, F.to_json(F.struct(*rest)).alias("doc")), url, name, [key], **options)
