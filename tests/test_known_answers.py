"""Known answers for single operators."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import pitch, text, vectors
from fathom.operators import archive, search, series, stateful, stats
from fathom.sources import readers, writers


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_degree_statistics(spark):
    rows = [("do", x) for x in (10.0, -10.0, 20.0)] + [("mi", x) for x in (-30.0, -50.0, -70.0)]
    got = {r.note: r for r in stats.summary(spark.createDataFrame(rows, "note string, cents double"), "cents", ["note"]).collect()}
    assert got["do"].n == 3 and round(got["do"].mean, 2) == 6.67 and round(got["do"].mean_abs, 2) == 13.33
    assert got["mi"].median == -50 and got["mi"].beyond == pytest.approx(1 / 3)


def test_pitch_functions(spark):
    r = one(spark, pitch.nearest_degree(F.lit(146.83)).alias("d"), pitch.nearest_degree(F.lit(0.0)).alias("z"), pitch.hz_to_cents(F.lit(440.0)).alias("c"), pitch.midi_to_hz(F.lit(69)).alias("h"), pitch.deviation_from(F.lit(440.0), F.lit("sol")).alias("s"), pitch.accuracy(F.lit(442.0), F.lit(440.0)).alias("a"))
    assert r.d.note == "do" and abs(r.d.cents) < 0.1 and r.z is None and r.c == pytest.approx(6900) and r.h == pytest.approx(440) and r.s == 0 and r.a.in_tune
    grid = [1.5, 301.5, 701.5]
    cases = [1.5, 40.0, 295.0, 555.0, 690.0, 1190.0, 5000.0]
    r = one(spark, *(pitch.snap(F.lit(c), F.array(*map(F.lit, grid))).alias(f"x{k}") for k, c in enumerate(cases)))
    for k, c in enumerate(cases):  # a plain loop over all degrees in all octaves
        far, at = min((abs(c - d - 1200 * n), d + 1200 * n) for d in grid for n in range(-1, 6))
        got = r[f"x{k}"]
        assert got.snapped != got.marked and got.cents == pytest.approx(at if got.snapped else c)
        assert got.snapped == (far <= 50) and 0 <= got.confidence <= 1


def test_cosine_and_validity(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    r = one(spark, vectors.cosine(v(1, 2), v(2, 4)).alias("p"), vectors.cosine(v(1, 0), v(0, 1)).alias("o"), vectors.cosine(v(1, 0), v(-1, 0)).alias("n"), vectors.cosine(v(0, 0), v(1, 0)).alias("z"), vectors.valid(v(0, 0), 2).alias("bad"), vectors.valid(v(0, 1), 2).alias("good"))
    assert (round(r.p, 9), r.o, r.n, r.z, r.bad, r.good) == (1, 0, -1, 0, False, True)


def events(spark, rows, gap=0.05):
    return series.note_events(spark.createDataFrame([(1, float(t), k, n, float(c)) for k, (t, n, c) in enumerate(rows)], "track int, t double, ord int, note string, cents double"), gap)


def test_segmentation_and_ornaments(spark):
    got = events(spark, [(0, "do", 0), (0.01, "do", 0), (0.02, "sol", 0), (0.03, "sol", 0), (0.2, "sol", 0)]).orderBy("island").collect()
    assert [r.note for r in got] == ["do", "sol", "sol"]
    kind = lambda n, cents: series.ornament(events(spark, [(k / 100, "sol", cents(k)) for k in range(n)])).first().kind
    assert kind(4, lambda k: 0) == "grace_note"
    assert kind(40, lambda k: 9 if k % 7 < 3 else -9) == "straight"
    assert kind(25, lambda k: -45 + 4 * k) == "glissando"
    assert kind(81, lambda k: 55 * math.sin(2 * math.pi * 5 * k / 100)) == "vibrato"
    assert kind(60, lambda k: 33 if k == 30 else 0) == "other"


def test_grid_fit_recovers_a_transposition(spark):
    r = np.random.default_rng(7)
    cents = r.choice([0, 200, 400, 700, 900], 600) + 150 + r.normal(0, 15, 600)
    rows = [(1, float(293.66 * 2 ** (c / 1200))) for c in cents] + [(2, 300.0)] * 50
    got = {x.track: x for x in series.grid_fit(spark.createDataFrame(rows, "track int, hz double"), [0, 200, 400, 700, 900]).collect()}
    assert abs(got[1].offset - 150) <= 10 and got[2].offset is None and got[2].n_frames == 50


@pytest.mark.parametrize("pcs, name", [({0: 5, 2: 1, 4: 1, 7: 2, 9: 1}, 0), ({9: 5, 0: 1, 2: 1, 4: 2, 7: 1}, 9), ({7: 5, 9: 1, 11: 1, 2: 2, 4: 1}, 7)])
def test_tonic(spark, pcs, name):
    h = spark.createDataFrame([(1, k, float(w)) for k, w in pcs.items()], "track int, pc int, weight double")
    assert series.tonic(h).first().tonic == name


def test_settled_notes_keep_a_vibrato_whole(spark):
    rows = [(1, k * 0.01, 6000 + 40 * math.sin(k), 0.9) for k in range(60)] + [(1, 0.6 + k * 0.01, 6200.0, 0.9) for k in range(60)] + [(1, 1.2 + k * 0.01, 0.0, 0.1) for k in range(20)]
    got = stateful.settle_notes(spark.createDataFrame(rows, "k int, t double, cents double, conf double"), "k").orderBy("start").collect()
    assert [round(r.cents / 100) for r in got] == [60, 62] and got[0].end == pytest.approx(0.6, abs=0.02)


def test_skyline(spark):
    rows = [(1, 0.0, 1.0, 0.5), (1, 0.5, 1.5, 0.9), (1, 0.6, 0.9, 0.8), (1, 2.0, 2.01, 1.0), (1, 3.0, 4.0, 0.1)]
    got = stateful.skyline(spark.createDataFrame(rows, "k int, start double, end double, amp double"), "k").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 0.5), (0.5, 1.5), (3.0, 4.0)]


def test_lag_pitch(spark):
    rows = [(1, i, math.sin(2 * math.pi * 220 * i / 8000)) for i in range(1024)] + [(2, i, 0.0) for i in range(200)]
    got = {r.k: r.hz for r in stateful.lag_pitch(spark.createDataFrame(rows, "k int, i int, x double"), "k", 8000).collect()}
    assert got[1] == pytest.approx(220, rel=0.02) and got[2] is None


def test_search_ranks_titles_over_transcripts(spark):
    rows = [(1, "love song", "x", 1), (2, "x", "love love", 2), (3, "x", "love", 3), (4, "x", "y", 9)]
    d = spark.createDataFrame(rows, "id int, title string, transcript string, created_at int")
    assert [r.id for r in search.search(d, "LOVE!").collect()] == [1, 2, 3]
    assert [r.id for r in search.search(d, " ").collect()] == [4, 3, 2, 1]


def test_names_and_dates(spark):
    r = one(spark, text.track_name(F.lit("track_0005_Side_B_Track_1_Name.mp3")).alias("t"), text.track_name(F.lit("test_001.wav")).alias("n"), text.catalog_title(F.lit("Songs by Some One")).alias("c"), text.trailing_date(F.lit("Title, 1966-08-25")).alias("d"), text.clean_segment(F.lit("♪ a [Music]  b")).alias("x"))
    assert (r.t.track_id, r.t.side, r.t.position) == ("track_0005", "B", 1) and r.n is None and r.c.artists == "Some One"
    assert (r.d.date, r.d.year, r.x) == ("1966-08-25", 1966, "a b")


def test_empty_input(spark):
    assert series.tonic(spark.createDataFrame([], "track int, pc int, weight double")).count() == 0
    assert events(spark, []).count() == 0
    assert stats.summary(spark.createDataFrame([], "x double"), "x").first().n == 0


def test_upsert_keeps_the_first_creation(spark):
    a = spark.createDataFrame([(1, 10, "x", 0)], "k int, created int, v string, seq int")
    b = spark.createDataFrame([(1, 99, "y", 1), (2, 50, "z", 2)], "k int, created int, v string, seq int")
    assert sorted((r.k, r.created, r.v) for r in archive.upsert(a, b, "k", "seq", ["created"]).collect()) == [(1, 10, "y"), (2, 50, "z")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("x.mp3", "y.WAV", "z.txt"):
        (tmp_path / "a" / n).write_bytes(b"abc")
    assert readers.files(spark, [str(tmp_path / "a"), str(tmp_path / "a")], ["mp3", "wav"]).count() == 2
    points = [{"time_sec": 0.1, "frequency_hz": 440.0, "confidence": 0.9, "note_label": "sol", "cents_deviation": 0.0}] * 2
    (tmp_path / "t_pitch.json").write_text(json.dumps({"track_id": "t", "points": points}, indent=1))
    assert [(r.pos, r.note_label) for r in readers.tracks(spark, str(tmp_path / "*_pitch.json")).collect()] == [(0, "sol"), (1, "sol")]
    (tmp_path / "c.csv").write_text("a,b\n1,x\nno,y\n")
    rows = readers.csv(spark, str(tmp_path / "c.csv"), "a INT, b STRING").collect()
    assert [r._corrupt is None for r in rows] == [True, False]
    wave = b"RIFF" + struct.pack("<I", 40) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 4) + struct.pack("<hh", 16384, -32768)
    got = readers.pcm16(spark.createDataFrame([(bytearray(wave),), (bytearray(b"no"),)], "content binary")).collect()
    assert (got[0].rate, got[0].samples, got[1].samples) == (8000, [0.5, -1.0], None)
    nested = spark.createDataFrame([(1, {"a": 1}, (2, [3]), "p")], "id int, m map<string,int>, s struct<x:int,y:array<int>>, files string")
    assert writers.flattened(nested).columns == ["id", "m", "s.x", "s.y", "files"]
    writers.dataset(nested, str(tmp_path / "out"), ["files"])
    assert "files" not in spark.read.json(str(tmp_path / "out/lite")).columns
    new, bad = writers.ingest(spark.createDataFrame([(1, 5), (2, -1), (3, 7)], "id int, v int"), spark.createDataFrame([(3,)], "id int"), "id", {"positive": F.col("v") > 0})
    assert [r.id for r in new.collect()] == [1] and [(r.id, r.errors) for r in bad.collect()] == [(2, ["positive"])]
    log = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, 0.3)], "step int, loss double")
    assert sorted(r.step for r in writers.resumed_log(log, spark.createDataFrame([(3, 0.2)], "step int, loss double"), 2).collect()) == [1, 2, 3]


def test_markup_vectors_and_ledger(spark, tmp_path):

    markup = '<note id="a" x="1"><tie type="start"/></note><note id="b"/><note id="c"><p/></note>'
    assert [(r.pos, r.note, r.tie) for r in readers.notes_in_xml(spark.createDataFrame([(markup,)], "m string"), "m").collect()] == [(0, "a", "start"), (1, "b", None), (2, "c", None)]
    np.save(tmp_path / "v1.npy", np.array([3.0, 4.0]))
    np.save(tmp_path / "v2.npy", np.zeros(2))
    assert sorted((r.id, r.vector) for r in readers.vectors(spark, str(tmp_path)).collect()) == [("v1", [0.6, 0.8]), ("v2", [0.0, 0.0])]
    path = str(tmp_path / "ledger")
    assert readers.ledger(spark, path).count() == 0
    rows = spark.createDataFrame([("s", "t", "done")], "stage string, track_id string, status string")
    assert [writers.save_ledger(rows, path), writers.save_ledger(rows, path)] == [0, 1]
    assert writers._claimed(spark, f"{path}/claims/2") and not writers._claimed(spark, f"{path}/claims/2")  # another writer is at it
    assert writers.save_ledger(rows, path) == 3
    (tmp_path / "ledger/2").mkdir()  # a version that was never finished
    (tmp_path / "ledger/2/part-0.json").write_text("{")
    assert readers.ledger(spark, path).count() == 1


def test_unknown_codes_are_errors(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    assert [r[0] for r in df.where("c is null or c = 'a'").select(text.encoded(F.col("c"), ["b", "a"])).collect()] == [1, None]
    with pytest.raises(Exception, match="unknown value"):
        df.select(text.encoded(F.col("c"), ["b", "a"])).collect()


def test_rate_windows_and_closure(spark):
    from fathom.operators.graph import closure

    d = spark.createDataFrame([(1, float(t), k) for k, t in enumerate((50, 70, 100, 109, 111))], "k int, t double, ord int")
    assert [(r.win, r.hits) for r in stateful.fixed_windows(d, "k", "t", "ord", 60, 2).orderBy("ord").collect()] == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1)]
    got = {r.node: r.root for r in closure(spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "a int, b int")).collect()}
    assert all(got[k] == 0 for k in range(10)) and got[21] == 20


def test_formats(spark):
    r = one(spark, *(text.clock(F.lit(x)).alias(f"c{k}") for k, x in enumerate((0.0, 65.9, 3725.0, -1.0))), *(text.file_size(F.lit(n)).alias(f"s{k}") for k, n in enumerate((10, 1536, 4404019, 1024**3, -5))))
    assert tuple(r) == ("0:00", "1:05", "1:02:05", "0:00", "10 B", "1.5 KB", "4.2 MB", "1 GB", "0 B")
    r = one(spark, text.file_extension(F.lit("https://a.b/c/x.y.MP3?sig=.z")).alias("a"), text.file_extension(F.lit("https://a.b/c/xy")).alias("b"), text.quality_score(F.lit(20.0), F.lit(0.0)).alias("q"), text.quality_score(F.lit(float("nan")), F.lit(0.0)).alias("n"))
    assert tuple(r) == (".mp3", "", 40.0, 0.0)


def test_word_error_rate(spark):
    r = one(spark, text.word_error_rate(F.lit("the cat sat down"), F.lit("The cat sits")).alias("a"), text.word_error_rate(F.lit(""), F.lit("x")).alias("b"), text.word_error_rate(F.lit("a b"), F.lit(None).cast("string")).alias("c"))
    assert (r.a, r.b, r.c) == (0.5, None, 1.0)


def test_word_edits_in_blocks_and_over_many_words(spark):
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    r = random.Random(3)
    for _ in range(400):
        a, b = ([b"%d" % r.randrange(k) for _ in range(r.randrange(12))] for k in (r.choice((2, 5, 30)),) * 2)
        assert {text.word_edits(a, b, n) for n in (1, 3, 4096)} == {plain(a, b)}
    # more distinct words than there are characters below the surrogates; white space that is none in ASCII parts no words
    words = [f"w{k}" for k in range(45_000)]
    other = [f"x{w}" if k % 9 == 0 else w for k, w in enumerate(words)]
    rows = spark.createDataFrame([(" ".join(words), "\n".join(other)), ("a\u00a0b c", "a\u2003b\tC")], "a string, b string")
    assert [x.wer for x in rows.select(text.word_error_rate(F.col("a"), F.col("b")).alias("wer")).collect()] == [5000 / 45_000, 0.5]
