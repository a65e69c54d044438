"""Queues with timers and resumable stages, batch by batch, against answers worked out by hand."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from fathom.streaming import keyed, queues, run

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MS = int(T0.timestamp() * 1000)


@pytest.fixture
def driven(spark, tmp_path):
    """Feeds files of events one after another, all to the same stream; gives what was said, in seconds from the start."""

    def go(name, f, *files):
        folder = tmp_path / name
        (folder / "in").mkdir(parents=True)
        for k, rows in enumerate(files):
            path = folder / "in" / f"{k:03d}.json"
            path.write_text("".join(json.dumps({"k": key, "ts": (T0 + dt.timedelta(seconds=s)).isoformat(), "seq": i, "kind": kind}) + "\n" for i, (key, s, kind) in enumerate(rows)))
            os.utime(path, (1_700_000_000 + k * 10,) * 2)
        s = spark.readStream.schema("k string, ts timestamp, seq long, kind string").option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        got = run.to_end(f(keyed.as_stream(s, late="0 seconds")), str(folder)).collect()
        return sorted((r.k, (r["at"] - MS) / 1000, r.action, r.number) for r in got)

    return go


RETRIED = [("a", 0, "transient"), ("a", 40, "transient"), ("a", 110, "transient"), ("a", 300, "transient"), ("b", 5, "permanent"), ("b", 6, "ok"), ("c", 7, "transient"), ("c", 20, "ok"), ("d", 400, "ok")]
WANT = [
    ("a", 0.0, "waiting", 1), ("a", 30.0, "retry", 1), ("a", 40.0, "waiting", 2), ("a", 100.0, "retry", 2), ("a", 110.0, "waiting", 3), ("a", 230.0, "retry", 3), ("a", 300.0, "failed", 4),
    ("b", 5.0, "rejected", 1), ("c", 7.0, "waiting", 1), ("c", 20.0, "complete", 2), ("d", 400.0, "complete", 1),
]


def test_failed_work_is_put_back_after_30_60_120_seconds(driven):
    f = lambda s: queues.retries(s, "k")
    assert driven("once", f, RETRIED) == WANT
    by_time = sorted(RETRIED, key=lambda x: x[1])
    assert driven("parts", f, by_time[:4], by_time[4:6], by_time[6:]) == WANT


def test_timer_fires_without_another_event_of_the_key(driven):
    got = driven("timer", lambda s: queues.retries(s, "k"), [("a", 0, "transient")], [("z", 100, "ok")])
    assert ("a", 30.0, "retry", 1) in got


def test_ended_work_is_forgotten(driven):
    f = lambda s: queues.retries(s, "k", keep_ms=50_000)
    assert driven("keep", f, [("a", 0, "ok"), ("a", 40, "ok"), ("a", 60, "ok")]) == [("a", 0.0, "complete", 1), ("a", 60.0, "complete", 1)]


def test_one_run_at_a_time_and_ghosts(driven):
    f = lambda s: queues.single_runs(s, "k", 60_000)
    events = [("a", 0, "submit"), ("a", 10, "submit"), ("a", 50, "beat"), ("a", 100, "done"), ("a", 120, "submit"), ("b", 0, "submit"), ("b", 90, "done"), ("b", 95, "submit"), ("b", 99, "error"), ("b", 130, "submit"), ("z", 500, "beat")]
    want = [
        ("a", 0.0, "started", 1), ("a", 10.0, "joined", 1), ("a", 100.0, "done", 1), ("a", 120.0, "finished", 1),
        ("b", 0.0, "started", 1), ("b", 60.0, "ghost", 1), ("b", 95.0, "started", 2), ("b", 99.0, "error", 2), ("b", 130.0, "started", 3), ("b", 190.0, "ghost", 3),
    ]
    assert driven("once", f, events) == want
    by_time = sorted(events, key=lambda x: x[1])
    assert driven("parts", f, by_time[:3], by_time[3:6], by_time[6:]) == want


def test_job_table(spark):
    rows = [("a", 0, "started", 1, 60), ("a", 5, "joined", 1, 60), ("b", 0, "started", 1, 60), ("b", 60, "ghost", 1, None), ("b", 90, "started", 2, 150), ("c", 200, "started", 1, 260)]
    said = spark.createDataFrame(rows, "k string, at long, action string, number int, until long")
    assert sorted(map(tuple, queues.job_table(said, "k", 100).collect())) == [("a", "running", 1), ("b", "running", 2)]


class Killed(BaseException):
    pass


def test_stage_goes_on_where_it_was_killed(spark, tmp_path):
    source, calls = tmp_path / "in", tmp_path / "calls"
    source.mkdir()
    calls.mkdir()
    for k in range(4):
        path = source / f"{k}.json"
        path.write_text("".join(json.dumps({"id": i, "x": i}) + "\n" for i in range(k * 10, k * 10 + 10)))
        os.utime(path, (1_700_000_000 + k * 10,) * 2)
    fuse = tmp_path / "fuse"
    fuse.write_text("")

    def process(row):
        if row["id"] == 25 and fuse.exists():
            raise Killed("the worker dies")
        with open(calls / str(row["id"]), "a") as f:
            f.write(".")
        if row["id"] % 7 == 0:
            raise ValueError(f"no {row['id']}")
        return {"y": row["x"] * 2}

    stage = run.Stage("double", str(tmp_path / "stage"), "id", process, "y long")
    items = lambda: spark.readStream.schema("id long, x long").option("maxFilesPerTrigger", 1).json(str(source))
    with pytest.raises(Exception, match="dies"):
        stage.run(items())
    everything = spark.range(50)
    states = lambda: {r.status: r["count"] for r in stage.ledger(everything).groupBy("status").count().collect()}
    assert states() == {"done": 17, "failed": 3, "pending": 30}
    fuse.unlink()
    stage.run(items())
    assert states() == {"done": 34, "failed": 6, "pending": 10}
    assert all((calls / str(i)).read_text() == "." for i in range(20))  # what was finished is not done again
    got = {r.id: (r.status, r.error, r.y) for r in stage.results(spark, "long").collect()}
    assert got[3] == ("done", None, 6) and got[14] == ("failed", "no 14", None) and len(got) == 40
    stage.run(items())
    assert states() == {"done": 34, "failed": 6, "pending": 10}


def test_stage_passes_over_finished_items_and_tries_failed_ones_again(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "bad"), (3, "wrong type")], "id long, x string")
    rows.coalesce(1).write.json(str(source))
    mended = tmp_path / "mended"

    def process(row):
        if row["x"] == "bad" and not mended.exists():
            raise ValueError("bad")
        return {"n": "text" if row["x"] == "wrong type" else len(row["x"])}

    stage = run.Stage("length", str(tmp_path / "stage"), "id", process, "n long")
    items = lambda: spark.readStream.schema("id long, x string").json(str(source))
    stage.run(items())
    assert {r.id: r.status for r in stage.results(spark, "long").collect()} == {1: "done", 2: "failed", 3: "failed"}
    mended.write_text("")
    rows.coalesce(1).write.mode("append").json(str(source))
    stage.run(items())
    assert {r.id: (r.status, r.n) for r in stage.results(spark, "long").collect()} == {1: ("done", 1), 2: ("done", 3), 3: ("failed", None)}
    assert stage.ledger(rows.select(F.col("id"))).count() == 3
