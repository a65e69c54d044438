"""The thin queries opN_<name>: each applies one operator of this folder to its whole table; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, document_fingerprints, license_scan, piece_bpe, simhash, substring_dedup, suffix_dedup, token_alignment, token_files, topk, toxicity, url_rules
from .common import table

#: Stated rules (verdict, host and path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("q"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"), window=35)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), window=50)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", toxicity.in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


#: The subsets of op12 as rows of SQL: number, factor, bits.
SUBSETS = ", ".join(f"({j + 1}, {f}, {b})" for j, (f, b) in enumerate(zip(document_fingerprints.FACTORS, document_fingerprints.BITS, strict=True)))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_url_filters, op4_exact_topk, op5_substring_dedup, op6_sentencepiece, op7_license_scan, op8_token_files, op9_suffix_dedup, op10_toxicity, op11_token_alignment, op12_document_fingerprints, op13_conversation_repair)}

SQL: dict[str, str] = {
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item, array_to_string(w[i:i + 12], ' ') AS g, least(len(w), 13) AS n FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM t), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
m AS (SELECT doc_id, i, p.n, item FROM p JOIN t ON p.g = t.g AND p.n = t.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
r AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, k FROM p SEMI JOIN r USING (g), LATERAL (SELECT unnest(range(i, i + 35)) AS k)),
w AS (SELECT doc_id, k, w[k] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t FROM w ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op4_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op12_document_fingerprints": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS rn, count(*) OVER () AS n FROM documents),
p AS (SELECT d.doc_id, d.rn, d.n, d.text, left(d.text, len(d.text) - len(d.text) // 2) || left(e.text, len(d.text) // 2) AS edited FROM d JOIN d e ON e.rn = d.rn % d.n + 1),
t AS (SELECT rn, 0 AS side, text FROM p UNION ALL SELECT rn, 1, edited FROM p),
w AS (SELECT rn, side, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS word FROM t),
lexicon AS (SELECT word FROM w WHERE side = 0 GROUP BY word HAVING count(*) * 2000 >= (SELECT count(*) FROM documents) AND count(*) * 10 <= (SELECT count(*) FROM documents)),
held AS (SELECT rn, side, w.word, l.word IS NOT NULL AS known, bool_or(l.word IS NOT NULL) OVER (PARTITION BY rn, side) AS any_known FROM w LEFT JOIN lexicon l ON w.word = l.word),
subsets(j, f, b) AS (VALUES (0, 0, 0), {SUBSETS}),
inside AS (SELECT word, j FROM (SELECT DISTINCT word, md5_number_lower(word) AS h FROM held WHERE known OR NOT any_known), subsets
  WHERE j = 0 OR (CAST(h AS HUGEINT) * f) % 18446744073709551616 < CAST(1 AS HUGEINT) << (64 - b)),
signatures AS (SELECT rn, side, j, md5(string_agg(word, ' ' ORDER BY word)) AS m FROM held JOIN inside USING (word) WHERE known OR NOT any_known GROUP BY rn, side, j),
prints AS (SELECT rn, side, string_agg(CASE WHEN j = 0 THEN left(coalesce(m, md5(text)), 16) ELSE coalesce(left(m, 6), '') END, ',' ORDER BY j) AS fp FROM t CROSS JOIN subsets LEFT JOIN signatures USING (rn, side, j) GROUP BY rn, side),
all_rows AS (SELECT p.*, a.fp AS a, b.fp AS b, c.fp AS c FROM p JOIN prints a ON a.rn = p.rn AND a.side = 0 JOIN prints b ON b.rn = p.rn AND b.side = 1 JOIN prints c ON c.rn = p.rn % p.n + 1 AND c.side = 0),
zipped AS (SELECT *, list_filter(list_zip(string_split(a, ','), string_split(b, ','), {document_fingerprints.WEIGHTS}), lambda z: z[1] <> '' OR z[2] <> '') AS x, list_filter(list_zip(string_split(a, ','), string_split(c, ','), {document_fingerprints.WEIGHTS}), lambda z: z[1] <> '' OR z[2] <> '') AS y FROM all_rows)
SELECT doc_id, CAST(len(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
 CAST(coalesce(list_sum(list_transform(list_filter(x, lambda z: z[1] = z[2]), lambda z: z[3])), 0) AS DOUBLE) / list_sum(list_transform(x, lambda z: z[3])) AS near_edited, CAST(coalesce(list_sum(list_transform(list_filter(y, lambda z: z[1] = z[2]), lambda z: z[3])), 0) AS DOUBLE) / list_sum(list_transform(y, lambda z: z[3])) AS near_next FROM zipped
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS kind FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, left(role, 1) AS i FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd'
  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) || i AS pair FROM placed),
steps(prev, next, ins) AS (VALUES ('', 's', 0), ('', 'u', 0), ('s', 'u', 0), ('a', 'u', 0), ('u', 'u', 1), ('u', 'a', 0), ('', 'a', 1), ('s', 'a', 1), ('a', 'a', 1)),
moves AS (SELECT conv_id, rn, p AS prev, p AS next, 3 AS price, 'D' AS edit FROM faults, (VALUES (''), ('s'), ('u'), ('a')) v(p)
  UNION ALL SELECT conv_id, rn, prev, next, 2 * ins + CASE WHEN i = next THEN 0 ELSE 2 END + CASE WHEN fault = 't' THEN 1 ELSE 0 END, repeat('I', ins) || CASE WHEN i = next THEN 'K' ELSE 'R' END
  FROM faults, steps WHERE fault NOT IN ('b', 'd') AND (i = next OR next <> 's')),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, '' AS st, {'c': CAST(0 AS BIGINT), 'a': ''} AS best FROM placed
  UNION ALL SELECT d.conv_id, m.rn, m.next, min({'c': d.best.c + m.price, 'a': d.best.a || m.edit}) FROM dp d JOIN moves m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.rn = d.rn + 1 AND m.prev = d.st GROUP BY d.conv_id, m.rn, m.next),
cheapest AS (SELECT dp.conv_id, min({'c': best.c + 2 * e.n, 'a': best.a || repeat('I', CAST(e.n AS BIGINT))}) AS best FROM dp JOIN (SELECT conv_id, max(rn) AS n FROM placed GROUP BY conv_id) l ON dp.conv_id IS NOT DISTINCT FROM l.conv_id AND dp.rn = l.n
  JOIN (VALUES ('', 0), ('s', 2), ('u', 1), ('a', 0)) e(st, n) ON e.st = dp.st GROUP BY dp.conv_id),
letters AS (SELECT conv_id, k, best.a[k] AS edit, k - len(replace(left(best.a, k), 'I', '')) AS before_it FROM cheapest, LATERAL (SELECT unnest(range(1, len(best.a) + 1)) AS k)),
lines AS (SELECT l.conv_id, k, edit, role, text, edit = 'K' AND i = 's' AS is_s, row_number() OVER (PARTITION BY l.conv_id, edit = 'K' AND i = 's' ORDER BY k) AS nth
  FROM letters l LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.rn = l.k - before_it AND edit <> 'I' WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN cheapest x ON o.conv_id IS NOT DISTINCT FROM x.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
""",
}
