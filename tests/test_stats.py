"""Quantiles of groups of any size and the index of vectors, against numpy."""

import math
import random

import numpy as np
import pytest

from fathom.operators import ivf, neighbours, stats


@pytest.mark.parametrize("small", [1_000_000, 20, 0])
def test_quantiles_of_any_size(spark, small):
    r = random.Random(1)
    draws = {"a": lambda: r.gauss(0, 1), "b": lambda: float(r.randint(0, 3)), "c": lambda: math.exp(r.gauss(0, 9)), "d": lambda: 7.0, None: lambda: -abs(r.gauss(0, 1e-300))}
    rows = [(k, f()) for k, f in draws.items() for _ in range(r.randint(150, 400))] + [("one", 5.0), ("none", None), ("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    points = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {x.k: [x.p0, x.p10, x.p50, x.p90, x.p100] for x in stats.quantiles(df, "x", ["k"], points, bins=16, small=small).collect()}
    want = {k: [v for g, v in rows if g == k and v is not None and not math.isnan(v)] for k in {g for g, _ in rows}}
    assert set(got) - {"none"} == set(want) - {"none"}
    for k, v in want.items():
        if v:
            assert got[k] == pytest.approx(np.percentile(v, [100 * p for p in points]).tolist(), rel=1e-12), k
    every = [v for vs in want.values() for v in vs]
    (x,) = stats.quantiles(df, "x", [], [0.5], small=small).collect()
    assert x.p50 == pytest.approx(np.median(every))
    assert stats.quantiles(df.limit(0), "x", ["k"], [0.5], small=small).collect() == []


def test_quantiles_with_infinite_values(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, math.inf)], "x double")
    assert stats.quantiles(df, "x", [], [0.5], small=1).first().p50 == 2.5


def test_neighbours_keep_ties_and_leave_out_the_row_itself(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 8))
    base[40:60] = base[3]  # twenty equal rows
    base[7] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(base)], "vec_id long, embedding array<double>").repartition(4)
    unit = neighbours.unit(base)
    for block in (1 << 20, 256):
        got = {}
        for x in neighbours.nearest(df, df.where("vec_id % 3 = 0"), 6, block_bytes=block).collect():
            got.setdefault(x.id, {})[x.rank] = x.other
        for q in range(0, 300, 3):
            order = sorted((k for k in range(300) if k != q), key=lambda k: (-round(float(unit[k] @ unit[q]), 9), k))[:6]
            assert [got[q][n] for n in range(1, 7)] == order


def test_inverted_file_index(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 10)) * 3
    rows = np.concatenate([c + r.normal(size=(80, 10)) for c in centres])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    c = ivf.kmeans(df, 6, 8)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and np.array_equal(np.round(c, 9), np.round(ivf.kmeans(df.repartition(5), 6, 8), 9))
    ivf.build(df, c, str(tmp_path / "ivf"))
    index = spark.read.parquet(str(tmp_path / "ivf/lists"))
    assert index.count() == len(rows)  # every row is in one list
    near = ivf.closest(neighbours.unit(rows), c, 1)[:, 0]
    assert {x.key: x.list for x in index.select("key", "list").collect()} == dict(enumerate(near.tolist()))
    q = df.where("vec_id % 20 = 0")
    exact = neighbours.nearest(df, q, 5)
    key = lambda d: sorted((x.id, x.rank, x.other) for x in d.collect())
    assert key(ivf.probe(spark, str(tmp_path / "ivf"), q, 5, None)) == key(exact)
    assert ivf.recall(ivf.probe(spark, str(tmp_path / "ivf"), q, 5, 2), exact).first().recall >= 0.9


def test_index_of_no_rows_and_of_fewer_rows_than_lists(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert len(ivf.kmeans(empty, 4, 2)) == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert len(ivf.kmeans(few, 4, 2)) == 2 and ivf.assigned(few, ivf.kmeans(few, 4, 2)).count() == 2


def test_p_of_the_rank_test_against_the_error_function_of_the_library(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 1.96 / math.sqrt(2), 3.0, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(stats.erfc(df.x)).collect()] == pytest.approx([math.erfc(x) for x in xs], abs=2e-7)
    r = random.Random(9)
    rows = [("a", round(r.gauss(0, 1), 1)) for _ in range(40)] + [("b", round(r.gauss(0.5, 1), 1)) for _ in range(30)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "g string, v double"), "g", "v", "a", "b").first()
    a, b = ([v for g, v in rows if g == x] for x in "ab")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n, ties = 70, sum(k**3 - k for k in (sum(v == w for _, v in rows) for w in {v for _, v in rows}))
    z = (abs(u - 600) - 0.5) / math.sqrt(40 * 30 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got.u == u and got.p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=2e-7)


def test_summary_is_the_same_for_large_groups(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(r.choice("abc"), r.gauss(0, 60)) for _ in range(500)], "k string, v double")
    for by in ([], ["k"]):
        a, b = (sorted(map(tuple, stats.summary(df, "v", by, small=n).collect())) for n in (1000, 20))
        assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))
