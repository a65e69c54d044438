"""URL filtering by association rules: FP-growth over URL tokens, matched by an inverted index. DataFrame functions only.

Labelled urls teach which combinations of tokens (top-level domain, registered domain, subdomain, path segments,
parameter names) go with which verdict. Rules below the least support or confidence are pruned. Each rule is posted
in an index under its rarest token, so that a url meets only the rules that can hold for it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CLASS = "verdict="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. rules: (verdict, host + path), few and stated by the caller.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long ones the last stands.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url. Digits are folded to ``#``, so that page numbers do not make every url its own token."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    n = F.size(labels)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.when(n > 0, F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)))).otherwise(F.array()),
            F.when(n > 1, F.array(F.concat(F.lit("domain:"), F.element_at(labels, -2)))).otherwise(F.array()),
            F.transform(F.when(n > 2, F.slice(labels, 1, F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")), lambda x: F.concat(F.lit("sub:"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "#"))),
            F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("param:"), F.substring_index(x, "=", 1))),
        )
    )


def mine_rules(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.9, partitions: int | None = None) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from labelled (url, verdict); null verdicts are left out.

    The number of rules is bound by the support: an itemset must hold for that part of the labelled urls. All labelled
    urls count. Without labelled urls there are no rules.
    """
    items = labelled.where(F.col("verdict").isNotNull()).select(F.array_append(url_tokens(F.col("url")), F.concat(F.lit(CLASS), "verdict")).alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if partitions:
        growth.setNumPartitions(partitions)
    rules = growth.fit(items).associationRules
    return rules.where(F.startswith(F.col("consequent")[0], F.lit(CLASS))).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(CLASS) + 1, 1 << 20).alias("verdict"), "confidence", "support"
    )


def match_rules(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key, mined (verdict of the best rule that holds): higher confidence, then support, longer, then first by text.

    The index has each rule under the token that fewest rules hold, so that frequent tokens post few rules. Pages are
    reduced to their distinct sets of tokens before the index is met; a set is judged once.
    """
    postings = rules.select(F.struct("tokens", "verdict", "confidence", "support").alias("rule"), F.explode("tokens").alias("token"))
    spread = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    index = postings.join(spread, "token").groupBy("rule").agg(F.min_by("token", F.struct("held", "token")).alias("token")).select("token", "rule.*")
    sets = pages.select(F.array_sort(url_tokens(F.col("url"))).alias("set")).groupBy("set").agg(F.count(F.lit(1)).alias("urls"))
    best = (
        sets.select("set", F.explode("set").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("tokens", "set")) == 0)
        .groupBy("set")
        .agg(F.max_by("verdict", F.struct("confidence", "support", F.size("tokens"), F.concat_ws(" ", "tokens"), "verdict")).alias("mined"))
    )
    return pages.select(key, F.array_sort(url_tokens(F.col("url"))).alias("set")).join(best, "set", "left").select(key, "mined")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], min_support: float = 0.01, min_confidence: float = 0.9, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    Stated rules judge the urls that they fit and label them for the mining; mined rules judge the rest; where none
    holds, ``otherwise`` stands. Null urls have an empty host and path and no tokens. Rows with equal or null ids are
    judged each for itself (each row carries its own url; nothing is joined by id). Other columns are not read.
    """
    url = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    url = url.withColumn("stated", longest_rule(F.col("host"), F.col("path"), rules))
    mined = written(mine_rules(url.select("url", F.col("stated.verdict").alias("verdict")), min_support, min_confidence))  # mined once
    row = url.select(F.struct("page_id", "host", "path", "stated").alias("row"), "url")
    judged = match_rules(row, mined, key="row")
    return judged.select(
        F.col("row.page_id").alias("page_id"), F.col("row.host").alias("host"), F.col("row.path").alias("path"), F.col("row.stated.rule").alias("rule"), F.coalesce("row.stated.verdict", "mined", F.lit(otherwise)).alias("verdict")
    )
