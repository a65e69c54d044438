"""SimHash, substring and suffix-array dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from fathom.llm import repeats, simhash, substring_dedup, suffix_dedup
from fathom.llm.components import components

LOW = {c: c + 32 for c in range(65, 91)}


def by_null(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["a", "bb", "c\n", "dd", "é", "f", "g h"]
    passages = [" ".join(r.choice(words) for _ in range(80)) for _ in range(6)]
    out = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 6)):
            a = r.randint(0, 60)
            parts.append(r.choice(passages)[a : a + r.randint(1, 150)] if r.random() < 0.6 else " ".join(r.choice(words) for _ in range(r.randint(1, 40))))
        text = " ".join(parts) if r.random() < 0.95 else "ab " * r.randint(1, 200)
        out.append((r.choice([None, i, i, i, i, i // 2]), r.choice([text] * 9 + [None])))
    return [*out, (900, "x" * 5000 + " tail"), (901, "x" * 5000)]


def repeated_words(docs, size):
    count = collections.Counter()
    parts = [re.findall(b"[^\x20\x09-\x0d]+", (x or "").encode()) for _, x in docs]
    for w in parts:
        count.update(tuple(w[a : a + size]) for a in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(docs, parts):
        gone = [0] * len(w)
        for a in range(len(w) - size + 1):
            if count[tuple(w[a : a + size])] > 1:
                gone[a : a + size] = [1] * size
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    return out


def repeated_bytes(docs, size):
    last = 2**63 - 1
    least = {}
    raw = [(last if d is None else d, (x or "").encode()) for d, x in docs]
    for d, t in raw:
        for a in range(len(t) - size + 1):
            least[t[a : a + size]] = min(least.get(t[a : a + size], last), d)
    out = []
    for (own, _), (d, t) in zip(docs, raw):
        gone = bytearray(len(t))
        for a in range(len(t) - size + 1):
            if least[t[a : a + size]] < d:
                gone[a : a + size] = b"\1" * size
        out.append((own, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, y in zip(t, gone) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize(("shard_bytes", "hot_runs"), [(8 << 20, None), (2000, None), (2000, 3)])
def test_substring_dedup(spark, texts, shard_bytes, hot_runs, monkeypatch):
    whole = substring_dedup.remove_repeats
    monkeypatch.setattr(substring_dedup, "remove_repeats", lambda *a: whole(*a, shard_bytes=shard_bytes, hot_runs=hot_runs))
    docs = spark.createDataFrame([(d, t, 1, b"s") for d, t in texts], "doc_id long, text string, shard int, keys binary")
    got = substring_dedup.digest(docs).collect()
    assert by_null(map(tuple, got)) == by_null(repeated_words(texts, 35))


@pytest.mark.parametrize(("shard_bytes", "hot_runs"), [(8 << 20, None), (2000, None), (2000, 3)])
def test_suffix_dedup(spark, texts, shard_bytes, hot_runs, monkeypatch):
    whole = suffix_dedup.remove_repeats
    monkeypatch.setattr(suffix_dedup, "remove_repeats", lambda *a: whole(*a, shard_bytes=shard_bytes, hot_runs=hot_runs))
    docs = spark.createDataFrame([(d, t, 1, b"s") for d, t in texts], "doc_id long, text string, shard int, keys binary")
    got = suffix_dedup.digest(docs).collect()
    assert by_null(map(tuple, got)) == by_null(repeated_bytes(texts, 50))


def test_rows_of_a_shard_in_any_order():
    """A shuffle hands a shard's rows over in another order each time; all steps count them alike."""
    import pyarrow as pa

    r = random.Random(2)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, b"", b"x y", b"z" * 60, b"z" * 70])) for _ in range(40)]
    table = lambda x: pa.table({"doc_id": pa.array([d for d, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.binary())})
    first = repeats.in_order(table(rows)).to_pylist()
    for _ in range(5):
        r.shuffle(rows)
        assert repeats.in_order(table(rows)).to_pylist() == first


def test_a_phrase_in_all_documents(spark, monkeypatch):
    """One anchor with thousands of distinct contents: its windows are dealt one by one."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    line = " ".join(word() for _ in range(30))
    rows = [(k, " ".join(word() for _ in range(12)) + f" {line} " + " ".join(word() for _ in range(r.choice([3, 12])))) for k in range(3000)]
    rows += [(5000 + k, rows[k][1]) for k in range(0, 600, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for module, brute, size in ((substring_dedup, repeated_words, 35), (suffix_dedup, repeated_bytes, 50)):
        whole = module.remove_repeats
        monkeypatch.setattr(module, "remove_repeats", lambda *a, whole=whole: whole(*a, shard_bytes=60_000))
        assert by_null(map(tuple, module.digest(docs).collect())) == by_null(brute(rows, size))


def test_very_long_text_in_small_shards(spark, monkeypatch):
    whole = suffix_dedup.remove_repeats
    monkeypatch.setattr(suffix_dedup, "remove_repeats", lambda *a: whole(*a, shard_bytes=10_000))
    r = random.Random(1)
    long = "".join(r.choice("ab c") for _ in range(400_000))
    rows = [(1, long), (2, "x" + long[1000:9000]), (None, long[:300]), (3, ""), (4, None)]
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_null(map(tuple, got)) == by_null(repeated_bytes(rows, 50))


def test_suffix_sort_is_lexicographic():
    r = np.random.default_rng(3)
    raw = [bytes(r.choice(list(b"ab"), 80)) for _ in range(40)] + [b"a" * 90, b"ab" * 45]
    text = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([np.arange(len(x) - 49) + k for x, k in zip(raw, np.cumsum([0, *map(len, raw)]))])
    order = suffix_dedup.Suffixes(text, 50, suffix_dedup.Powers(suffix_dedup.BASES[0])).sort(starts)
    whole = text.tobytes()
    assert [whole[a : a + 50] for a in order] == sorted(whole[a : a + 50] for a in starts)
    assert sorted(order) == sorted(starts)


def test_factors_cover_windows_over_their_ends():
    words = [b"%d" % k for k in range(60)]
    one, two, both = words[:40], words[20:], words
    block = substring_dedup.Block([one, two, both], np.array([1, 1, 1]), 10)
    start, source, size = block.factors()
    own = start >= 80
    assert (size >= 10).all() and own.sum() == 2  # the text of both parts is two factors that overlap
    assert (block.ids[start] == block.ids[source]).all()


def test_cut_passages_keeps_columns(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"first {passage}", "x", 5), (2, f"{passage} second é", "y", 6), (3, None, None, None), (4, passage, "z", 1), (5, "", "e", 0)]
    got = {r.doc_id: r for r in suffix_dedup.cut_passages(spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1].text == rows[0][1] and got[1].n_chars == 5 and got[1].row == "x"
    assert got[2].text == " second é" and got[2].n_chars == 9
    assert got[3].text is None and got[5].text == ""


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.digest(docs).count() == 0
    assert suffix_dedup.cut_passages(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0


def brute_fingerprint(text, size=3):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    parts = [" ".join(w[a : a + size]) for a in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(codes, distance):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= distance
    root = np.arange(len(codes))
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            return root
        root = new


def test_fingerprints_and_components(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, rows[0][1]), (5000, ""), (5001, None), (5002, " \t"), (5003, "One"), (5004, rows[0][1]), (5004, rows[0][1])]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, bits int, root int")
    got = by_null((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    codes = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    root = brute_roots(codes, 3)
    least = {}
    for (d, _), k in zip(rows, root):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    assert got == by_null((d, f"{c:016x}", least.get(k)) for (d, _), c, k in zip(rows, codes, root))


@pytest.mark.parametrize("limit", [4096, 60])
def test_links_of_dense_groups(spark, limit):
    r = np.random.default_rng(1)
    codes = set()
    for b in r.integers(0, 2**63, 60).tolist():
        for _ in range(int(r.integers(1, 40))):
            for k in r.integers(0, 64, int(r.integers(0, 5))).tolist():
                b ^= 1 << k
            codes.add(b)
    codes = np.array(sorted(codes), np.uint64)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "bits long"), 3, limit=limit)
    got = {r.node: r.root for r in components(edges).collect()}
    signed = codes.view(np.int64)
    sets = collections.defaultdict(list)
    for k, root in enumerate(brute_roots(codes, 3)):
        sets[root].append(int(signed[k]))
    assert all(got.get(x, x) == min(s) for s in sets.values() for x in s)


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100), (7, 7), (50, 60), (60, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[60] == got[50] == 50
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(texts, size=5):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        out.append({" ".join(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    return out


def test_similar_documents_recall(spark):
    """Edited copies at similarities around the limit: nearly all above it are linked, nothing far below it is."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for k in range(150):
        base = [word() for _ in range(r.randint(80, 400))]
        rows.append((2 * k, " ".join(base)))
        edited = base[:]
        for _ in range(int(len(base) * r.choice([0, 0.005, 0.01, 0.02, 0.06, 0.1]))):
            edited[r.randrange(len(edited))] = word()
        rows.append((2 * k + 1, " ".join(edited)))
    rows += [(None, rows[0][1]), (1000, ""), (1001, None)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = shingle_sets([t for _, t in rows])
    similar = [(k, len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1])) for k in range(150)]
    near, far = [k for k, s in similar if s >= 0.8], [k for k, s in similar if s < 0.65]
    assert len(near) > 50 and len(far) > 20
    assert sum(got[2 * k + 1] == 2 * k for k in near) >= 0.9 * len(near)
    assert not any(got[2 * k + 1] == 2 * k for k in far)
    assert got[1001] == got[1000] == 1000 and got[None] == 0


def test_similar_documents_are_confirmed_by_their_sets(spark):
    """7 of 9 shingles shared look like 0.8 to a fingerprint, but do not link; 8 of 10, exactly 0.8, do."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for k in range(40):
        base = [word() for _ in range(12)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join([*base[:11], word()]))]  # 7 of 9
        base = [word() for _ in range(13)]
        rows += [(10 * k + 2, " ".join(base)), (10 * k + 3, " ".join([*base[:12], word()]))]  # 8 of 10
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * k + 1] == 10 * k + 1 for k in range(40))
    assert sum(got[10 * k + 3] == 10 * k + 2 for k in range(40)) > 20


def test_similar_documents_count_a_shingle_once(spark):
    """A line repeated 50 times does not make texts alike, and repeats do not part texts whose sets are similar."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    line = [word() for _ in range(10)]
    rows = [(k, " ".join(line * 50 + [word() for _ in range(300)])) for k in range(10)]
    for k in range(10):
        base = [word() for _ in range(104)]
        rows += [(100 + 2 * k, " ".join(base)), (101 + 2 * k, " ".join(base + base[:14] * 20))]  # 100 of 108 shingles
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == k for k in range(10))
    assert all(got[101 + 2 * k] == 100 + 2 * k for k in range(10))


def test_similar_documents_equal_brute_force(spark):
    """All pairs at 0.8 or more link, most of these at 0.80 to 0.85, and no others."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    line = [word() for _ in range(9)]
    rows = []
    for k in range(150):
        base = [word() for _ in range(r.choice([12, 13, 40, 80, 150]))] + line * (k % 3)
        rows.append((2 * k, " ".join(base)))
        edited = base[:]
        for _ in range(max(1, round(len(base) * r.choice([0.018, 0.021, 0.024, 0.027])))):
            edited[r.randrange(len(edited))] = word()
        rows.append((2 * k + 1, " ".join(edited)))
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = shingle_sets([t for _, t in rows])
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    root = np.arange(len(rows))
    while not np.array_equal(new := np.array([root[n].min() for n in near]), root):
        root = new
    assert sum(near[2 * k, 2 * k + 1] for k in range(150)) > 40
    assert [got[k] for k in range(300)] == root.tolist()
