"""Conversation repair against SQL, and against a search over all edits of short conversations."""

import hashlib
import heapq
import itertools
import random
import re

import duckdb
import pytest

from fathom.llm import conversations
from fathom.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(initials, faults):
    """Price and audit by a search over all states of an automaton with single edits; nothing of the operator's method."""
    heap, done = [(0, "", 0, "")], {}
    while heap:
        price, audit, k, seen = heapq.heappop(heap)
        if (k, seen) in done and done[k, seen] <= (price, audit):
            continue
        done[k, seen] = (price, audit)
        if k == len(initials) and re.fullmatch("(s?(ua)+)?", seen):
            return price, audit
        for c in "ua":
            if len(seen) < 2 * len(initials) + 4:
                heapq.heappush(heap, (price + 2, audit + "I", k, seen + c))
        if k < len(initials):
            heapq.heappush(heap, (price + 3, audit + "D", k + 1, seen))
            if faults[k] not in (conversations.BLANK, conversations.DUPLICATE):
                more = faults[k] == conversations.TRUNCATED
                heapq.heappush(heap, (price + more, audit + "K", k + 1, seen + initials[k][:1]))
                for c in "ua":
                    heapq.heappush(heap, (price + 2 + more, audit + "R", k + 1, seen + c))


def test_prices_are_the_least_of_all_edits():
    for n in range(5):
        for initials in itertools.product("suax" if n < 4 else "sua", repeat=n):
            got = conversations.closed(conversations.prices(list(initials), [0] * n))
            assert got[:2] == cheapest(initials, [0] * n), initials
    r = random.Random(1)
    for _ in range(150):
        n = r.randint(1, 5)
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        assert conversations.closed(conversations.prices(initials, faults))[:2] == cheapest(initials, faults), (initials, faults)


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(SQL["op13_conversation_repair"])
    return sorted((tuple(r) for r in rel.fetchall()), key=str)


def odd_rows(n=400):
    r = random.Random(4)
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Well?  \n", "é.", None, "a.b", "…", "x" * 3000 + "."]
    return [(r.choice([None, *range(25)]), r.choice([None, None, *range(-3, 12)]), r.choice(["user", "assistant", "system", "", "tool", None, "Äh"]), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("most", [5_000, 4, 0])
def test_nulls_ties_and_repeats_at_any_size(spark, most):
    rows = odd_rows()
    turns = conversations.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = conversations.repair(turns, most_turns=most)
    assert sorted(map(tuple, got.collect()), key=str) == sql(rows)
    texts = {}
    for t in sorted(conversations.repaired_turns(turns, most_turns=most).collect(), key=lambda t: t.at):
        texts.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    for row in got.collect():
        lines = texts.get(row.conv_id, [])
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == row.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_one_conversation_with_most_rows(spark):
    rows = [(7, k, "user" if k % 3 else "assistant", f"turn {k % 500}.") for k in range(3000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hello.")]
    turns = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, conversations.repair(turns, most_turns=n).collect())) for n in (5_000, 100))
    assert a == b and [x[0] for x in a] == [7, 8] and a[1][6:8] == (0, "KK")


def test_empty_table_and_clashing_columns(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    rows = [(1, 0, "user", "Hi.", "z", 3), (1, 1, "user", "There.", "z", 3)]
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA + ", key string, place int")).collect()
    assert [(r.cost, r.audit, r.illegal) for r in got] == [(2, "KR", 1)]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    df = QUERIES["op13_conversation_repair"](spark, folder)
    rel = con.sql(SQL["op13_conversation_repair"])
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r) for r in rel.fetchall())
