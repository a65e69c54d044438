"""Text expressions: tokens, cleaning, names and dates in titles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, words and limits that equal results ask for.
STAGE_TAG = r"(?i)[\[\(]\s*(?:music|applause|laughter|singing|instrumental|foreign|noise)\s*[\]\)]"
NOTE_GLYPHS = "[♪♫♬]+"
TRAILING_DATE = r",\s*((19\d{2})(?:-\d{2}-\d{2})?)\s*$"
TRACK_NAME = r"^track_(\d{4})_(.+)$"
SIDE_AND_TRACK = r"(?i)^Side_([AB])_Track_(\d+)_?(.*)$"
CATALOG_SIDE = r"(?i)^Side\s+([AB])\.?\s*Track\s+(\d+):?\s*(.*)$"
CATALOG_ARTISTS = r"(?i)^Songs\s+by\s+(.+)$"
NO_SPEECH_LIMIT, COMPRESSION_LIMIT, LOGPROB_LIMIT = 0.6, 2.4, -1.0
TEMPO_WORDS = ("slow", "moderate", "lively")  # below 80, to 120, beyond
# End of the fixed values.


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def clean_segment(text: Column) -> Column:
    """Without note glyphs and stage tags, white space folded."""
    text = F.regexp_replace(text, NOTE_GLYPHS, " ")
    text = F.regexp_replace(text, STAGE_TAG, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trailing_date(text: Column) -> Column:
    """struct(date, year) of a date at the end, after a comma; nulls without one."""
    hit = TRAILING_DATE
    date = F.regexp_extract(text, hit, 1)
    return F.struct(F.nullif(date, F.lit("")).alias("date"), F.regexp_extract(text, hit, 2).try_cast("int").alias("year"))


def track_name(filename: Column) -> Column:
    """struct(track_id, index, slug, side, position) of ``track_0005_Side_B_Track_1_Name.mp3``; null for other names."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    index, slug = F.regexp_extract(stem, TRACK_NAME, 1), F.regexp_extract(stem, TRACK_NAME, 2)
    side = SIDE_AND_TRACK
    return F.when(
        stem.rlike(TRACK_NAME),
        F.struct(F.concat(F.lit("track_"), index).alias("track_id"), index.try_cast("int").alias("index"), slug.alias("slug"), F.upper(F.nullif(F.regexp_extract(slug, side, 1), F.lit(""))).alias("side"), F.regexp_extract(slug, side, 2).try_cast("int").alias("position")),
    )


def catalog_title(title: Column) -> Column:
    """struct(kind, side, position, song_title, artists) of a catalogue title."""
    title = F.trim(title)
    side, by = CATALOG_SIDE, CATALOG_ARTISTS
    none = F.lit(None).cast("string")
    track = F.struct(F.lit("track").alias("kind"), F.upper(F.regexp_extract(title, side, 1)).alias("side"), F.regexp_extract(title, side, 2).try_cast("int").alias("position"), F.nullif(F.trim(F.regexp_extract(title, side, 3)), F.lit("")).alias("song_title"), none.alias("artists"))
    songs = F.struct(F.lit("cassette").alias("kind"), none.alias("side"), F.lit(None).cast("int").alias("position"), none.alias("song_title"), F.trim(F.regexp_extract(title, by, 1)).alias("artists"))
    plain = F.struct(F.lit("cassette").alias("kind"), none.alias("side"), F.lit(None).cast("int").alias("position"), title.alias("song_title"), F.nullif(F.regexp_replace(F.regexp_replace(title, "and others$", ""), "^[ ,]+|[ ,]+$", ""), F.lit("")).alias("artists"))
    return F.when(title.rlike(side), track).when(title.rlike(by), songs).otherwise(plain)


def only_keyword(text: Column, keywords: list[str]) -> Column:
    """The capitalised keyword, if exactly one of them occurs."""
    hits = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), k))
    return F.when(F.size(hits) == 1, F.initcap(hits[0]))


def decade(year: Column) -> Column:
    return F.concat(F.substring(year.cast("string"), 1, 3), F.lit("0s"))


def hash_percent(key: Column) -> Column:
    """The SHA-1 of a key as a number, modulo 100, folded digit by digit."""
    digits = F.sha1(key)
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda a, i: (a * 16 + F.conv(F.substr(digits, i, F.lit(1)), 16, 10).cast("int")) % 100)


def split_of(key: Column, train_percent: int = 80) -> Column:
    return F.when(hash_percent(key) < train_percent, "train").otherwise("val")


def file_extension(url: Column) -> Column:
    """Lower-cased extension, with its dot, of the last segment of a url's path; empty without one. The query is ignored."""
    last = F.regexp_extract(F.substring_index(url, "?", 1), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"[^.].*?(\.[^.]*)$", 1))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def clock(seconds: Column) -> Column:
    """m:ss or h:mm:ss; 0:00 for what is negative or not finite."""
    s = F.floor(F.when((seconds >= 0) & (seconds < float("inf")), seconds).otherwise(0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s % 60))).otherwise(F.concat_ws(":", m.cast("string"), two(s % 60)))


def file_size(n: Column) -> Column:
    """A count of bytes as B, KB, MB or GB, to a tenth; 0 B for what is negative."""
    n = F.when(n >= 0, n).otherwise(0)
    tenth = lambda x: F.regexp_replace((F.floor(x * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    k = F.lit(1024.0)
    return F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < k * k, F.concat(tenth(n / k), F.lit(" KB"))).when(n < k * k * k, F.concat(tenth(n / k / k), F.lit(" MB"))).otherwise(F.concat(tenth(n / k / k / k), F.lit(" GB")))


def quality_score(snr: Column, peak: Column) -> Column:
    """0-100 from a signal-to-noise ratio of up to 40 dB; ten less where the peak clips; 0 where it was not measured."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), snr / 40.0 * 100.0)) - F.when(peak >= -0.1, 10.0).otherwise(0.0)
    return F.when(snr.isNull() | F.isnan(snr), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), base), 1))


def segment_confidence(logprob: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(logprob))), F.lit(0.0))


def looks_hallucinated(no_speech: Column, compression: Column, logprob: Column) -> Column:
    return (F.coalesce(no_speech, F.lit(0.0)) > NO_SPEECH_LIMIT) | (F.coalesce(compression, F.lit(1.0)) > COMPRESSION_LIMIT) | (F.coalesce(logprob, F.lit(0.0)) < LOGPROB_LIMIT)


def word_edits(a: list[bytes], b: list[bytes], block: int = 4096) -> int:
    """Words to put in, take out or replace, to come from one list to the other: Myers' bit vectors, in blocks of words of a, so
    that the places of its words take bounded memory. A block gets the steps (1, 0, -1) along the last row of the one before."""
    if a == b:
        return 0
    steps = [1] * len(b)
    for start in range(0, len(a), block):
        part = a[start : start + block]
        places: dict[bytes, int] = {}
        for k, word in enumerate(part):
            places[word] = places.get(word, 0) | 1 << k
        full, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
        up, down = full, 0
        for j, word in enumerate(b):
            step, same = steps[j], places.get(word, 0)
            either = same | down
            if step < 0:
                same |= 1
            flat = (((same & up) + up) ^ up) | same
            right, left = down | (full & ~(flat | up)), up & flat
            steps[j] = 1 if right & last else -1 if left & last else 0
            right, left = right << 1 | (step > 0), left << 1 | (step < 0)
            up, down = (left | ~(either | right)) & full, right & either & full
    return len(a) + sum(steps)


@F.arrow_udf(T.DoubleType())
def _error_rate(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    pairs = ((a.split(), b.split()) for a, b in zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True))
    return pa.array([word_edits(a, b) / len(a) if a else None for a, b in pairs], pa.float64())


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits between the words of two texts, by the number of reference words; null without reference words.

    Words are parted at ASCII white space, as bytes, in which Python's split is that of the JVM's \\s.
    """
    return _error_rate(*(F.lower(F.coalesce(x, F.lit(""))).cast("binary") for x in (reference, hypothesis)))


def caption(genre: Column, bpm: Column, tonic: Column, year: Column, style: str = "traditional song") -> Column:
    """A description of a clip, from what is known of it."""
    word = F.when(bpm < 80, TEMPO_WORDS[0]).when(bpm <= 120, TEMPO_WORDS[1]).otherwise(TEMPO_WORDS[2])
    first = F.when(F.coalesce(genre, F.lit("")) != "", F.concat_ws(", ", genre, F.lit(style))).otherwise(style)
    era = F.when(F.coalesce(year.cast("string"), F.lit("")) != "", decade(year)).otherwise("vintage")
    return F.concat_ws(", ", first, F.concat(word, F.lit(" at "), F.bround(bpm).cast("long").cast("string"), F.lit(" BPM")), F.concat(F.lit("pentatonic melody rooted on "), tonic), F.concat(era, F.lit(" archival recording")))


def tonic_in_caption(text: Column, names: list[str]) -> Column:
    """The pitch class that a caption names, from 0; null without one."""
    found = F.array_position(F.array(*map(F.lit, names)), F.trim(F.regexp_extract(text, "rooted on ([^,]*)", 1)))
    return F.when(found > 0, (found - 1).cast("int"))


def encoded(value: Column, codes: list[str]) -> Column:
    """The place of a value in the code book, from 0; null stays null, an unknown value is an error."""
    book = F.create_map(*(x for k, c in enumerate(codes) for x in (F.lit(c), F.lit(k))))
    return F.when(value.isNotNull(), F.coalesce(book[value], F.raise_error(F.concat(F.lit("unknown value: "), value)).cast("int")))


def attribution(text: Column) -> Column:
    """Without a trailing date; blank as null."""
    return blank_to_null(F.regexp_replace(text, TRAILING_DATE, ""))


def name_parts(filename: Column) -> Column:
    """struct(artist, title) of ``artist_some_title.mp3``: before and after the first underscore, the rest as spaces."""
    stem = F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")
    return F.struct(F.substring_index(stem, "_", 1).alias("artist"), F.nullif(F.replace(F.array_join(F.slice(F.split(stem, "_"), 2, 1 << 20), "_"), F.lit("_"), F.lit(" ")), F.lit("")).alias("title"))
