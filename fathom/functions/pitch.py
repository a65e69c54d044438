"""Pitch arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of the pentatonic scale and their reference frequencies.
DEGREES = [("do", 293.66), ("re", 329.63), ("mi", 369.99), ("sol", 440.00), ("la", 493.88)]
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def octave_folded_cents(hz: Column, reference: Column | float) -> Column:
    """Signed cents from the reference, folded to [-600, 600); octaves do not matter."""
    return F.pmod(F.log2(hz / reference) * 1200.0 + 600.0, F.lit(1200.0)) - 600.0


def nearest_degree(hz: Column) -> Column:
    """struct(note, cents): the degree with the least deviation, the first of equal ones; null for hz <= 0."""
    each = F.array(*(F.struct(F.abs(octave_folded_cents(hz, F.lit(ref))).alias("off"), F.lit(k).alias("ord"), F.lit(n).alias("note"), octave_folded_cents(hz, F.lit(ref)).alias("cents")) for k, (n, ref) in enumerate(DEGREES)))
    best = F.array_min(each)
    return F.when(hz > 0, F.struct(best["note"].alias("note"), best["cents"].alias("cents")))


def deviation_from(hz: Column, degree: Column) -> Column:
    """Cents from a named degree; null for an unknown name."""
    table = F.create_map(*(x for n, ref in DEGREES for x in (F.lit(n), F.lit(ref))))
    return octave_folded_cents(hz, table[degree])


def pitch_class_cents(hz: Column, reference: float = DEGREES[0][1]) -> Column:
    return F.pmod(F.log2(hz / reference) * 1200.0, F.lit(1200.0))


def hz_to_cents(hz: Column) -> Column:
    """Absolute cents on the MIDI scale; null where there is no pitch (hz <= 0)."""
    return F.when(hz > 0, (F.log2(hz / 440.0) * 12.0 + 69.0) * 100.0)


def midi_to_hz(midi: Column, offset_cents: float = 0.0) -> Column:
    return F.pow(F.lit(2.0), (midi - 69 + offset_cents / 100.0) / 12.0) * 440.0


def circular_distance(cents: Column, degrees: Column) -> Column:
    """Least circular distance (of 1200) to any of an array of degrees in cents."""
    return F.array_min(F.transform(degrees, lambda d: F.abs(F.pmod(F.pmod(cents, F.lit(1200.0)) - d + 600.0, F.lit(1200.0)) - 600.0)))


def snap(cents: Column, degrees: Column, tolerance: float = 50.0) -> Column:
    """struct(cents, distance, confidence, snapped, marked): within the tolerance to the nearest degree, else left and marked."""
    off = lambda d: F.pmod(F.pmod(cents, F.lit(1200.0)) - d + 600.0, F.lit(1200.0)) - 600.0
    nearest = F.array_min(F.transform(degrees, lambda d, i: F.struct(F.abs(off(d)).alias("a"), i.alias("i"), off(d).alias("o"))))
    near = nearest["a"] <= tolerance
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - nearest["a"] / 100.0))
    return F.struct(F.when(near, cents - nearest["o"]).otherwise(cents).alias("cents"), nearest["a"].alias("distance"), confidence.alias("confidence"), near.alias("snapped"), (~near).alias("marked"))


def accuracy(hz: Column, target: Column) -> Column:
    """struct(cents to a tenth, score 0-100, in_tune within 15 cents); a pitch that is not positive counts as on target."""
    cents = F.when((hz > 0) & (target > 0), F.log2(hz / target) * 1200.0).otherwise(0.0)
    half_up = lambda x: F.floor(x + 0.5)
    return F.struct((half_up(cents * 10) / 10).alias("cents"), half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.abs(cents)))).alias("score"), (F.abs(cents) <= 15).alias("in_tune"))


def tempo_word(bpm: Column) -> Column:
    return F.when(bpm < 80, "slow").when(bpm <= 120, "moderate").otherwise("lively")
