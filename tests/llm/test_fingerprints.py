"""Document fingerprints against SQL, and what their likeness tells."""

import hashlib
import random
import statistics

import duckdb
import pytest

from fathom.llm import document_fingerprints
from fathom.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string"


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted((tuple(r) for r in con.sql(SQL["op12_document_fingerprints"]).fetchall()), key=str)


def odd_rows():
    r = random.Random(2)
    words = ["the", "of", "Ärger", "日本", "x1", "𓂀", "naïve", "A", "b", *(f"w{k}" for k in range(200))]
    texts = [None, "", " ", "!!", "the", "the of", "é" * 9, "word" * 5000, *(" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(90))]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, None), (5, "tie"), (5, "tie"), (5, "another")]


@pytest.mark.parametrize("most", [document_fingerprints.MOST_TERMS, 3])
def test_nulls_ties_and_both_ways(spark, most):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, 1, True) for d, t in rows], SCHEMA + ", part int, first boolean").repartition(3)
    got = document_fingerprints.fingerprints(docs, most_terms=most)
    assert sorted(map(tuple, got.collect()), key=str) == sql(rows)


def test_one_row_and_no_rows(spark):
    assert document_fingerprints.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    (r,) = document_fingerprints.fingerprints(spark.createDataFrame([(4, "abcd")], SCHEMA)).collect()
    assert (r.n_chars, r.edited_sha256, r.near_next) == (4, hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_equal_texts_and_likeness(spark):
    r = random.Random(3)
    base = [f"term{k}" for k in range(3000)]
    texts = [" ".join(r.sample(base, 120)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts)]
    got = {x.doc_id: x for x in document_fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].fingerprint == got[100 + k].fingerprint for k in range(60))
    assert statistics.mean(x.near_edited for x in got.values()) > 0.1 > 0.05 > statistics.mean(x.near_next for x in got.values())


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = QUERIES["op12_document_fingerprints"](spark, folder)
    rel = con.sql(SQL["op12_document_fingerprints"])
    assert rel.columns == df.columns
    got = df.collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in rel.fetchall())
    assert sum(x.near_edited > x.near_next for x in got) > 0.9 * len(got)
