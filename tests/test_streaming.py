"""Streams over files, driven to their end, against plain Python."""

import datetime as dt
import json
import os
import uuid

import pytest

from fathom.streaming import keyed

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def streamed(spark, tmp_path):
    """Feeds batches of rows one after another; returns all rows that came out."""

    def run(batches, schema, f, mode="append"):
        folder, out = tmp_path / uuid.uuid4().hex, []
        folder.mkdir()
        for k, rows in enumerate(batches):
            path = folder / f"{k:03d}.json"
            path.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
            os.utime(path, (1_700_000_000 + k * 10,) * 2)  # files are taken by age
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        q = f(s).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).trigger(availableNow=True).foreachBatch(lambda d, n: out.extend(d.collect())).start()
        q.awaitTermination(120)
        assert not q.exception()
        return out

    return run


def at(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).isoformat()


def test_rate_limit_starts_at_the_first_hit(streamed):
    rows = [{"k": 1, "ts": at(s)} for s in (50, 70, 100, 109, 111)]
    got = streamed([rows[:2], rows[2:]], "k int, ts timestamp", lambda s: keyed.rate_limited(keyed.as_stream(s), "k", 60_000, 2))
    assert [(r.hits, r.allowed) for r in sorted(got, key=lambda r: r["at"])] == [(1, True), (2, True), (3, False), (4, False), (1, True)]


def test_lockout(streamed):
    rows = [{"k": "a", "ts": at(s), "ok": ok} for s, ok in ((0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (70, True))]
    got = streamed([rows[:4], rows[4:]], "k string, ts timestamp, ok boolean", lambda s: keyed.lockout(keyed.as_stream(s), "k", 3, 60_000))
    assert [(r.failures, r.locked) for r in sorted(got, key=lambda r: r["at"])] == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (3, True), (0, False)]
    rows = [{"k": "a", "ts": at(s), "ok": ok} for s, ok in ((0, False), (1, False), (62, False), (130, True), (131, False))]
    got = streamed([rows[:2], rows[2:]], "k string, ts timestamp, ok boolean", lambda s: keyed.lockout(keyed.as_stream(s), "k", 2, 60_000))
    assert [(r.failures, r.locked) for r in sorted(got, key=lambda r: r["at"])] == [(1, False), (2, True), (3, True), (0, False), (1, False)]


def test_jobs_end_once_and_go_stale(streamed):
    a = [{"k": 1, "ts": at(0), "kind": "queued"}, {"k": 1, "ts": at(5), "kind": "running"}, {"k": 2, "ts": at(6), "kind": "running"}]
    b = [{"k": 1, "ts": at(9), "kind": "succeeded"}, {"k": 1, "ts": at(10), "kind": "running"}]
    c = [{"k": 9, "ts": at(99999), "kind": "queued"}]
    d = [{"k": 9, "ts": at(99999), "kind": "queued"}]
    got = streamed([a, b, c, d], "k int, ts timestamp, kind string", lambda s: keyed.jobs(keyed.as_stream(s, late="1 second"), "k", 60_000))
    assert [r.status for r in got if r.k == 1] == ["queued", "running", "succeeded"]
    assert [r.status for r in got if r.k == 2] == ["running", "failed"]


@pytest.mark.parametrize("refresh, hits", [(True, [True, True, False]), (False, [True, False, False])])
def test_values_expire(streamed, refresh, hits):
    rows = [{"k": 1, "ts": at(s), "kind": kind} for s, kind in ((0, "put"), (5, "get"), (8, "put"), (15, "get"), (30, "get"))]
    got = streamed([rows], "k int, ts timestamp, kind string", lambda s: keyed.expiring(keyed.as_stream(s), "k", 10_000, refresh))
    assert [r.hit for r in sorted(got, key=lambda r: r["at"]) if r["at"] % 10_000 in (5_000, 0) and r["at"] != min(x["at"] for x in got)] == hits


def test_stages_merge_out_of_order(streamed):
    rows = [{"k": 1, "seq": 3, "a": None, "b": 7}, {"k": 1, "seq": 1, "a": 5, "b": 1}, {"k": 1, "seq": 2, "a": 6, "b": None}]
    got = streamed([[r] for r in rows], "k int, seq int, a int, b int", lambda s: keyed.merged_stages(s, "k", "seq", ["a", "b"]), "update")
    assert (got[-1].a, got[-1].b) == (6, 7)
    got = streamed([[r] for r in rows], "k int, seq int, a int, b int", lambda s: keyed.mirror(s, "k", "seq", ["b"]), "update")
    assert got[-1].b == 7


def test_windows_and_duplicates(streamed):
    rows = [{"k": 1, "ts": at(s)} for s in (0, 10, 70, 200)]
    last = [{"k": 1, "ts": at(9000)}]
    schema = "k int, ts timestamp"
    quick = lambda s: keyed.as_stream(s, late="1 second")
    assert [r.n for r in sorted(streamed([rows, last, last], schema, lambda s: keyed.tumbling(quick(s), "1 minute", ["k"])), key=lambda r: r.window.start)] == [2, 1, 1]
    assert sum(r.n for r in streamed([rows, last, last], schema, lambda s: keyed.sliding(quick(s), "1 minute", "30 seconds", ["k"]))) == 8
    assert [r.n for r in sorted(streamed([rows, last, last], schema, lambda s: keyed.sessions(quick(s), "65 seconds", ["k"])), key=lambda r: r.session_window.start)] == [3, 1]
    assert len(streamed([rows, rows], schema, lambda s: keyed.once(keyed.as_stream(s), ["k", "ts"]))) == 4


def test_index_follows_publication(spark, streamed, tmp_path):
    path, schema = str(tmp_path / "index"), "id int, seq int, status string, title string"
    run = keyed.index_changes(path, "id", {"title": 2.0}, buckets=8)
    index = lambda: sorted((r.id, r.term, r.weight) for r in keyed.index_postings(spark, path, spark.createDataFrame([], "id int, term string, weight double").schema).collect())
    assert index() == []
    run(spark.createDataFrame([(1, 1, "published", "a a b"), (2, 2, "draft", "b"), *((k, 1, "published", "x") for k in range(10, 40))], schema), 0)
    rest = [(k, "x", 2.0) for k in range(10, 40)]
    assert index() == [(1, "a", 4.0), (1, "b", 2.0), *rest]
    change = spark.createDataFrame([(1, 3, "archived", "a"), (2, 4, "published", "c"), (2, 5, "published", "d")], schema)
    for _ in range(2):  # a batch that runs again gives the same index
        run(change, 1)
        assert index() == [(2, "d", 2.0), *rest]
    manifest = keyed.index_manifest(spark, path)
    assert sorted(set(manifest.values())) == [0, 1] and len([n for n in manifest.values() if n == 1]) <= 2  # other buckets were not written


def test_index_of_small_tasks(spark, tmp_path):
    """Postings of a bucket come from several tasks where there are many; the index is the same."""
    rows = spark.createDataFrame([(k, k % 3, "published", f"w{k % 7} x y{k}") for k in range(300)], "id int, seq int, status string, title string")
    found = []
    for name, more in (("few", {}), ("many", {"task_bytes": 500, "task_postings": 100})):
        path = str(tmp_path / name)
        for number in range(2):
            keyed.index_changes(path, "id", {"title": 2.0}, buckets=2, **more)(rows.where(f"id % 2 = {number} OR id < 50"), number)
        found.append(sorted((r.id, r.term, r.weight) for r in keyed.index_postings(spark, path, spark.createDataFrame([], "id int, term string, weight double").schema).collect()))
    assert found[0] == found[1] and len(found[0]) == 900
    assert all(len(list((tmp_path / "many" / "data" / "1" / f"bucket={k}").glob("*.parquet"))) > 1 for k in range(2))
