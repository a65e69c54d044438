"""Every query of the plans against DuckDB on the smallest tables."""

import duckdb
import pytest

from fathom.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


def views(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


#: Sums of doubles on the edge of a rounding show on more rows only.
LARGER = ["A1_note_statistics", "A2_dominant_notes", "A16_pitch_class_histogram", "A19_conformity"]


@pytest.mark.parametrize("name", LARGER)
def test_larger_table(spark, name):
    sf = "/root/testdata/sf0.01"
    check(spark, sf, views(sf), name)


#: Numbers of which a cast or a narrower type decides show on the largest table only.
LARGEST = ["F_A1_F_A5_arrays", "J27_pivot_compare"]


@pytest.mark.parametrize("name", LARGEST)
def test_largest_table(spark, name):
    sf = "/root/testdata/sf0.1"
    check(spark, sf, views(sf), name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    check(spark, sf, con, name)


def check(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(r) for r in rel.fetchall()]
    mine = [tuple(r[c] for c in rel.columns) for r in got]
    assert ordered(mine) == ordered(want)
