"""Conversation structure: faults of turns, and the cheapest repair to (s?(ua)+)? by initials of the roles.

The repair is found over retained turns only: turn j, kept or given another role, follows a retained turn i < j at the price
of the turns deleted between (a difference of prefix sums) and of the empty turns that their two roles need between them. Of
all i with one role the least "price so far minus deletions so far" is enough, so each role has one running minimum, and a
conversation takes time linear in its turns. Equal prices are decided by the audit, the edits' initials in order.

A conversation of bounded size is read in one go in its task, in the order of a sorted shuffle. Larger ones are cut into
fragments by ranges of turns. A fragment is priced for each role that may stand before it and each that it may end with; the
prices are put together in order, and then each fragment knows its edits. Only the hash of a repaired text, which can't be
taken in parts, runs through one task for each conversation, a turn at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Prices.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
#: What stands last in the retained part: nothing, a first system turn, a user's or an assistant's turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Empty turns that a turn needs before it, by what stands before and by its own role; none where it can't follow.
NEEDS = {(NONE, SYSTEM): 0, (NONE, USER): 0, (SYSTEM, USER): 0, (ASSISTANT, USER): 0, (USER, USER): 1, (USER, ASSISTANT): 0, (NONE, ASSISTANT): 1, (SYSTEM, ASSISTANT): 1, (ASSISTANT, ASSISTANT): 1}
#: Empty turns that the end needs.
AT_END = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

MOST_TURNS, MOST_BYTES = 5_000, 8 << 20
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, at long, role string, text string, edit string"


def prices(initials: list[str], faults: list[int], before: int = NONE) -> dict[int, tuple[int, str]]:
    """For each role that can stand last after these turns: the least price and its audit. before: what stands before."""
    #: role that stands last -> (price, less all deletions up to there; its audit; the place after it)
    least: dict[int, tuple[int, str, int]] = {before: (0, "", 0)}
    for j, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        if fault in (BLANK, DUPLICATE):
            continue
        deleted = DELETE * j
        found = {}
        for role in (SYSTEM, USER, ASSISTANT):
            keep = OF_INITIAL.get(initial) == role
            if not keep and role == SYSTEM:
                continue
            own = (0 if keep else REROLE) + (CUT_OFF if fault == TRUNCATED else 0)
            ways = [(price + deleted + INSERT * n + own, audit + "D" * (j - at) + "I" * n + ("K" if keep else "R")) for last, (price, audit, at) in least.items() if (n := NEEDS.get((last, role))) is not None]
            if ways:
                found[role] = min(ways)
        for role, (price, audit) in found.items():
            old = least.get(role)
            if old is None or (price, audit) < (old[0] + deleted + DELETE, old[1] + "D" * (j + 1 - old[2])):
                least[role] = (price - deleted - DELETE, audit, j + 1)
    n = len(initials)
    return {role: (price + DELETE * n, audit + "D" * (n - at)) for role, (price, audit, at) in least.items()}


def closed(ends: dict[int, tuple[int, str]]) -> tuple[int, str, int]:
    """The cheapest way to an end that is allowed: price, audit, the role that stands last before the turns set at the end."""
    return min((price + INSERT * AT_END[role], audit + "I" * AT_END[role], role) for role, (price, audit) in ends.items())


def edited(audit: str, turns: Iterator[tuple[str, str]], last: int = NONE) -> Iterator[tuple[str, str, str]]:
    """Role, text and edit of each turn of the repaired conversation."""
    for edit in audit:
        if edit == "I":
            role, text = ("assistant", "") if last == USER else ("user", "")
        else:
            role, text = next(turns)
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if last == USER else "user"
        last = OF_INITIAL[role[:1]]
        yield role, text, edit


class Facts:
    """Counts over the turns of a conversation, or of a fragment of one, in order."""

    def __init__(self):
        self.initials: list[str] = []
        self.faults: list[int] = []
        self.turns: set[int] = set()
        self.illegal = 0

    def add(self, turn: int | None, role: str, fault: int) -> None:
        if self.initials and self.initials[-1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(role[:1])
        self.faults.append(fault)
        if turn is not None:
            self.turns.add(turn)

    def count(self, fault: int) -> int:
        return sum(x == fault for x in self.faults)


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of a sorted stream by their first columns: (key, rows), a row at a time. Rows that were not read are passed over."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held: list = [next(rows, None)]
    while held[0] is not None:
        key = held[0][: len(keys)]

        def own(key=key):
            while held[0] is not None and held[0][: len(keys)] == key:
                row, held[0] = held[0], next(rows, None)
                yield row

        mine = own()
        yield key, mine
        for _ in mine:
            pass


def _prepared(turns: DataFrame) -> DataFrame:
    """key (conv_id, or empty), conv_id, turn, role, text, times, blank, cut_off. Null roles and texts are one space."""
    c = {x.lower(): x for x in turns.columns}
    times = F.col(c["times"]).cast("int") if "times" in c else F.lit(1)
    t = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times.alias("times"),
    )
    stem = F.rtrim(F.col("text"), F.lit(WHITE))
    return t.withColumns({"blank": stem == "", "cut_off": ~F.substring(stem, -1, 1).isin(".", "!", "?")})


def _short(rows: DataFrame, whole: bool) -> DataFrame:
    """Reports, or the repaired turns, of conversations of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, own in _runs(batches, "key"):
            facts, texts, seen, conv_id = Facts(), [], set(), None
            for _, conv_id, turn, role, text, times, blank, cut_off in own:  # noqa: B007
                for _ in range(times):
                    fault = BLANK if blank else DUPLICATE if (role, text) in seen else TRUNCATED if cut_off else FINE
                    seen.add((role, text))
                    facts.add(turn, role, fault)
                    texts.append((role, text))
            cost, audit, _ = closed(prices(facts.initials, facts.faults))
            new = edited(audit, iter(texts))
            if whole:
                out += [(conv_id, k, *x) for k, x in enumerate(new)]
            else:
                gaps = max(facts.turns) - min(facts.turns) + 1 - len(facts.turns) if facts.turns else 0
                sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text, _ in new).encode()).hexdigest()
                out.append((conv_id, gaps, *(facts.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), facts.illegal, cost, audit, sha))
            if len(out) >= 1000:
                yield _batch(out, TURNS if whole else REPORT)
                out = []
        yield _batch(out, TURNS if whole else REPORT)

    sorted_rows = bounded_batches(rows).repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return sorted_rows.mapInArrow(run, TURNS if whole else REPORT)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


FRAGMENT = "key string, conv_id long, part long, n long, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<string>"
PLACED = "key string, part long, before int, edits string, report array<string>"
LINE = "key string, place long, nth int, role string, text string, edit string"


def _long(rows: DataFrame, whole: bool) -> DataFrame:
    """The same for conversations of any size, by fragments."""
    hashed = rows.withColumn("h", F.md5("text"))
    first = hashed.where("times > 0").groupBy("key", "role", "h").agg(F.min(F.coalesce("turn", F.lit(-(1 << 63)))).alias("since"))  # null turns come first
    rows = hashed.join(first, ["key", "role", "h"], "left").withColumn("again", F.coalesce("turn", F.lit(-(1 << 63))) != F.col("since"))
    # equal turns of a conversation stay in one range; ranges are in order, and so are the numbers of rows in them
    laid = rows.repartitionByRange("key", "turn").sortWithinPartitions("key", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id())
    laid = written(laid.select("key", F.shiftright("place", 33).alias("part"), "place", "conv_id", "turn", "role", "text", "h", "times", "blank", "cut_off", "again"))

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part), own in _runs(batches, "key", "part"):
            facts, previous, conv_id = Facts(), None, None
            for _, _, _, conv_id, turn, role, h, times, blank, cut_off, again in own:  # noqa: B007
                for _ in range(times):
                    fault = BLANK if blank else DUPLICATE if again or previous == (turn, role, h) else TRUNCATED if cut_off else FINE
                    previous = (turn, role, h)
                    facts.add(turn, role, fault)
            ways = [f"{before},{end},{price},{audit}" for before in range(4) for end, (price, audit) in prices(facts.initials, facts.faults, before).items()]
            t, i = facts.turns, facts.initials
            yield _batch([(key, conv_id, part, len(i), min(t, default=None), max(t, default=None), len(t), *(facts.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), facts.illegal, i[0] if i else None, i[-1] if i else None, ways)], FRAGMENT)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), own in _runs(batches, "key"):
            best: dict[int, tuple[int, str]] = {NONE: (0, "")}
            came: list[tuple[int, dict[int, tuple[int, str]]]] = []
            least: list[int] = []
            most: list[int] = []
            sums, illegal, last, conv_id = [0] * 4, 0, None, None
            for _, conv_id, part, _, low, high, turns, blank, duplicate, truncated, bad, start, end, ways in own:  # noqa: B007
                least, most = least + [low] * (low is not None), most + [high] * (high is not None)
                sums = [x + y for x, y in zip(sums, (turns, blank, duplicate, truncated), strict=True)]
                illegal += bad + (last is not None and start is not None and last + start not in ("su", "ua", "au"))
                last = last if end is None else end
                new: dict[int, tuple[int, str, int, str]] = {}
                for before, after, price, audit in (w.split(",") for w in ways):
                    if (b := int(before)) in best:
                        way = (best[b][0] + int(price), best[b][1] + audit, b, audit)
                        new[int(after)] = min(way, new.get(int(after), way))
                came.append((part, {q: (b, audit) for q, (_, _, b, audit) in new.items()}))
                best = {q: (price, audit) for q, (price, audit, _, _) in new.items()}
            cost, audit, at = closed(best)
            gaps = max(most) - min(least) + 1 - sums[0] if least else 0
            report = [str(x) for x in (gaps, *sums[1:], illegal, cost)] + [audit]
            more = "I" * AT_END[at]
            for k, (part, ways) in enumerate(reversed(came)):
                at, edits = ways[at]
                yield _batch([(key, part, at, edits + ("" if k else more), [] if k else report)], PLACED)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, part, before, edits), own in _runs(batches, "key", "part", "before", "edits"):
            at = [part << 33]

            def turns(own=own, at=at):
                for _, _, _, _, place, role, text, times in own:
                    for _ in range(times):
                        at[0] = place
                        yield role, text

            out: list[tuple] = []
            nth = 0
            for x in edited(edits, turns(), before):
                nth += 1
                out.append((key, at[0], nth, *x))
                if len(out) >= 200:
                    yield _batch(out, LINE)
                    out = []
            yield _batch(out, LINE)

    light = laid.select("key", "part", "place", "conv_id", "turn", "role", "h", "times", "blank", "cut_off", "again")
    fragments = light.repartition("key", "part").sortWithinPartitions("key", "part", "place").mapInArrow(priced, FRAGMENT)
    placed = written(fragments.repartition("key").sortWithinPartitions("key", "part").mapInArrow(composed, PLACED))
    texts = laid.join(placed.select("key", "part", "before", "edits"), ["key", "part"]).select("key", "part", "before", "edits", "place", "role", "text", "times")
    lines = texts.repartition("key", "part").sortWithinPartitions("key", "part", "place").mapInArrow(repaired, LINE)
    ids = F.when(F.col("key") != "", F.col("key").cast("long"))
    if whole:
        return lines.select(ids.alias("conv_id"), (F.shiftleft(F.shiftright("place", 33), 33) + F.col("nth")).alias("at"), "role", "text", "edit")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key,), own in _runs(batches, "key"):
            sha, first = hashlib.sha256(), True
            for _, _, _, role, text, _ in own:
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            yield _batch([(key, sha.hexdigest())], "key string, sha string")

    ordered = lines.repartition("key").sortWithinPartitions("key", F.shiftright("place", 33), "nth").mapInArrow(summed, "key string, sha string")
    r = F.col("report")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return placed.where(F.size("report") > 0).join(ordered, "key", "left").select(
        ids.alias("conv_id"), *(r[k].cast("long").alias(n) for k, n in enumerate(names)), r[6].alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def _all(turns: DataFrame, whole: bool, most_turns: int, most_bytes: int) -> DataFrame:
    rows = _prepared(turns)
    sizes = rows.groupBy("key").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("size"))
    large = written(sizes.where((F.col("n") > most_turns) | (F.col("size") > most_bytes)).select("key"))
    if large.isEmpty():
        return _short(rows, whole)
    return _short(rows.join(large, "key", "left_anti"), whole).unionByName(_long(rows.join(large, "key", "left_semi"), whole))


def repair(turns: DataFrame, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A row of REPORT for each conv_id of turns (conv_id, turn, role, text; times, if there: how often the row counts).

    Turns are in order of turn, null turns first, equal ones by role and text. A row with times 0 only says that there is
    such a conversation. Null roles and texts are one space; null ids are one conversation. Empty texts are blank. Repeated
    rows are duplicates. A conversation without turns has zeros, an empty audit and the hash of an empty text. Other columns
    are not read; without rows there are no rows.
    """
    return _all(turns, False, most_turns, most_bytes)


def repaired_turns(turns: DataFrame, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The turns of the repaired conversations: conv_id, at (their order), role, text, edit (K, R or I)."""
    return _all(turns, True, most_turns, most_bytes)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults set by crc32 of "conv_id:turn" mod 20 (nulls are one space): 0 drops a row (times 0), 1 empties its
    text, 2 takes out its full stops and marks, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    role, text = part("role"), part("text")
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
