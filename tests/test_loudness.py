"""Energies of weighted steps, by pieces, against the filters run sample by sample."""

import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import loudness
from fathom.operators.stateful import scan


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(3)
    rows = [(k, i, None if r.random() < 0.02 else r.uniform(-1, 1)) for k, n in ((1, 9000), (2, 399), (3, 400), (4, 4001), (5, 1)) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k int, i int, x double").repartition(3).cache()


@pytest.mark.parametrize("piece", [1, 130, 400, 1000, 1 << 16])
def test_pieces_equal_a_single_run(samples, piece):
    few = samples.where("i < 900") if piece == 1 else samples
    want = {(r.k, r.step): r.energy for r in scan(few, "k", ["x"], ["i"], lambda: loudness.Weighted(4000), "step long, energy double").collect()}
    got = {(r.k, r.step): r.energy for r in loudness.step_energies(few, "k", 4000, piece, 2500).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-11) for k in want)


def test_a_key_is_no_single_task(samples):
    pieces = loudness._pieces(samples, "k", loudness.Linear(4000), 1000, 2500)
    assert pieces.where("k = 1").select("part").distinct().count() > 1
    assert pieces.agg(F.max("n"), F.sum("n")).first() == (1000, 9000 + 399 + 400 + 4001 + 1)
