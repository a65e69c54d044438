"""Ranked search over weighted fields: postings of (document, field weight, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import text

#: Boosts of the fields.
WEIGHTS = {"title": 6.0, "artist_name": 4.0, "poet_name": 3.0, "occasion": 2.0, "era": 2.0, "genre": 2.0, "transcript": 1.5, "translation": 1.0}


def _weighed(column: str, weight: float) -> Column:
    return F.transform(text.tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def _score(column: str, weight: float, times: Column) -> Column:
    return F.aggregate(text.tokens(F.col(column)), F.lit(0.0), lambda s, t: s + F.coalesce(times[t], F.lit(0.0)) * weight)


def postings(docs: DataFrame, key: str = "id", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """key, term, weight (boost times term frequency), summed over fields before anything is shuffled far."""
    fields = [_weighed(c, w) for c, w in weights.items() if c in docs.columns]
    return docs.select(key, F.explode(F.concat(*fields)).alias("p")).groupBy(key, "p.term").agg(F.sum("p.w").alias("weight"))


def search(docs: DataFrame, query: str, key: str = "id", created: str = "created_at", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Documents with their score, best first, then newest, then by key. A query without terms keeps all with score 0.

    Terms repeated in the query count again. Tokens that the query does not ask for never leave the scan.
    """
    spark = docs.sparkSession
    asked = [r[0] for r in spark.range(1).select(F.explode(text.tokens(F.lit(query)))).collect()]
    if not asked:
        return docs.withColumn("score", F.lit(0.0)).orderBy(F.desc(created), key)
    times = {t: asked.count(t) for t in asked}
    table = F.create_map(*(x for t, n in times.items() for x in (F.lit(t), F.lit(float(n)))))
    score = sum((_score(c, w, table) for c, w in weights.items() if c in docs.columns), F.lit(0.0))
    return docs.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc(created), key)
