"""Decontamination, tokenizers, token files, toxicity, licenses, urls and search against brute force or libraries."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from fathom.llm import decontamination, license_scan, piece_bpe, token_files, topk, toxicity, url_rules
from fathom.llm.queries import QUERIES, SQL, URL_RULES, tokenizer_path

LOW = {c: c + 32 for c in range(65, 91)}
SAMPLES = [" ", "  ", "a", "e", "th", "ing", "'s", "'", "▁", "\n", "\t", "é", "日", "𓂀", "\x00", "\x1c", "\x85", "\xa0", "<s>", "<0x41>", "!!", "...", "0", "12", "�", "́", "er", "on", "     ", "--", "\r", ",", ".", "<|endoftext|>", "_", "²"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(SAMPLES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_piece_bpe_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    own = piece_bpe.loaded(tokenizer_path("piece_bpe_32k.model"))
    for text in [*random_texts(3000), "x" * 3000, " " * 3000, "word " * 2000]:
        ids = sp.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == sp.decode(ids)
    r = random.Random(2)
    for _ in range(500):
        ids = [r.randrange(32000) for _ in range(r.randint(0, 6))] + [r.randrange(3, 259) for _ in range(r.randint(0, 5))]
        assert own.decode(ids) == sp.decode(ids)


def test_piece_bpe_table_keeps_the_last_token_of_each_prefix():
    own = piece_bpe.loaded(tokenizer_path("piece_bpe_32k.model"))
    for word in ("▁internationalisation", "▁thththingly", "▁Éclairxyz"):
        for k in range(1, len(word) + 1):
            assert own.encode_chunk(word[:k]) == own.merge(word[:k])


def test_encode_decode_rows(spark):
    rows = [(1, "Hello world", 9), (None, None, 9), (1, "Hello world", 9), (2, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = piece_bpe.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    assert [(r.doc_id, r.decoded) for r in got] == [(1, "Hello world"), (None, ""), (1, "Hello world"), (2, "")]
    assert got[1].ids == [] and got[0].ids == got[2].ids


def test_byte_bpe_equals_the_library():
    own = token_files.ByteBpe(tokenizer_path("byte_bpe_50k.json"), cache_size=500)
    for text in random_texts(3000):
        assert own.encode([text])[0] == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_byte_bpe_words_are_encoded_without_the_signs_at_their_ends():
    own, asked = token_files.ByteBpe(tokenizer_path("byte_bpe_50k.json")), []
    together = own._together
    own._together = lambda words: asked.extend(words) or together(words)
    r = random.Random(4)
    ends = ["", ".", ",", "...", "'", "'.", "''", "_", "&&&", ")]", "\u00bf", "\u0301", "\u0301.", "'s.", "1!", "\u00b2.", "\u0378."]
    words = ["", "the", "Etwas", "na\u00efve", "42", "\u65e5\u672c", "'", "don't", "\nline", "\u00a0x", "w" * 300]
    texts = [" ".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 9))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    asked.clear()
    own.encode(["a Wort, Wort. Wort; Wort Wort!!"])
    assert asked == [" a", " Wort"]
    assert own.encode([]) == []


def test_token_file_reads_only_the_frames_asked_for():
    out = io.BytesIO()
    w = token_files.Writer(out, frame_bytes=400)
    docs = [np.arange(k, dtype="<u4").tobytes() for k in (10, 0, 60, 200, 5, 90)]
    for k, x in enumerate(docs):
        w.add(None if k == 1 else k, x)
    w.close()
    raw = out.getvalue()
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert reader.tokens(4) == docs[4] and reader.frames_read == 1
    assert [reader.tokens(k) for k in range(6)] == docs
    assert reader.index["doc_id"].to_pylist() == [0, None, 2, 3, 4, 5]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == b"".join(docs)
    bad = bytearray(raw)
    bad[20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(io.BytesIO(bytes(bad)), len(bad)).tokens(0)


def test_token_files_round_trip(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9000, ""), (9001, "a")], "doc_id long, text string"))
    tok, start, want = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0, []
    for d, t in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.round_trip_digests(docs, tokenizer_path("byte_bpe_50k.json")).collect())) == sorted(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.round_trip_digests(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def brute_contamination(docs, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for i, x in items:
        w = pattern.findall((x or "").translate(LOW))
        for a in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[a : a + 13])].add("" if i is None else str(i))
    sizes, out = {len(w) for w in windows}, []
    for d, x in docs:
        w = pattern.findall((x or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (key := tuple(w[a : a + n])) in windows:
                    found |= windows[key]
                    hit[a : a + n] = [1] * n
        h = sum(hit)
        out.append((d, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 2000])
def test_decontamination(spark, sf, block_bytes):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(800, "Zwei Wörter"), (801, ""), (None, None), (802, items[0][1]), (None, "alpha beta gamma")]
    docs += [(None, items[0][1]), (7001, items[0][1]), (7004, "w " * 50_000 + items[0][1]), (None, None), (7000, ""), (7001, "und ZWEI wörter, zwei wörter"), (7002, items[0][1] + " " + items[1][1]), (7003, "x alpha beta gamma"), (7003, "x")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(docs, items)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, decontamination.report(d, b, block_bytes=block_bytes).collect()), key=key) == sorted(want, key=key)
    kept = decontamination.decontaminate(d, b, block_bytes=block_bytes)
    assert kept.columns == ["doc_id", "text", "row"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in want if not r[5])
    assert decontamination.report(d.limit(0), b).count() == 0 and decontamination.report(d, b.limit(0)).where("contaminated").count() == 0


def test_longest_matches(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"w{k}" for k in range(5, 25)) + " z " + item)], "doc_id long, text string")
    got = sorted(map(tuple, decontamination.longest_matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()))
    assert got == [(1, 2, 20, "7", 5), (1, 23, 30, "7", 0)]


def test_toxicity_learns_gapped_insults(spark):
    r = random.Random(4)
    clean = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(400)]
    insults = ["blorkzik", "quavvex", "zzumpfk"]
    make = lambda bad: ". ".join(" ".join(r.choice(clean) for _ in range(12)) for _ in range(4)) + (f". you {r.choice(insults)} you" if bad else ". you and you")
    rows = [(k, make(k % 4 == 0), int(k % 4 == 0)) for k in range(360)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {x.doc_id: x for x in toxicity.scored(docs, model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(held) > 90 and sum(got[k].predicted == y for k, y in held) >= 0.97 * len(held)
    assert got[1000].predicted == got[1001].predicted == 0 and 0 <= got[None].score <= 1
    assert toxicity.keep_clean(docs, model).where("doc_id % 4 = 0 and doc_id < 360").count() < 5
    base = model.values(["blorkzik", "blorxkzik", "abcdefgh"])
    assert min(base[:2]) > base[2] + 0.2  # a letter put in does not hide the insult
    assert toxicity.words("you b l o r k ok")[-1].replace(" ", "") == "blork"


def test_toxicity_models_do_not_mix(spark):
    """Two models used in turn in one session, with workers that live on, keep giving their own scores."""
    docs = spark.createDataFrame([(k, f"alpha{k} beta gamma delta") for k in range(40)], "doc_id long, text string")
    r = np.random.default_rng(2)
    models = [toxicity.Model(r.normal(size=1 << 3 * toxicity.SYMBOLS).astype(np.float32), 0.0, 1.0, 0.0, 0.0) for _ in range(2)]
    want = [sorted((x.doc_id, x.score) for x in toxicity.scored(docs, m).collect()) for m in models]
    assert want[0] != want[1]
    for k in range(12):
        assert sorted((x.doc_id, x.score) for x in toxicity.scored(docs, models[k % 2]).collect()) == want[k % 2]


def test_string_kernel_equals_a_naive_one():
    """Inner products of features are the gapped subsequence kernel, counted triple by triple."""
    units = ["idiot", "idixot", "aa", "b", "moron", "mor0n", "xxidiotxx", "é-ß"]

    def naive(a, b):
        def triples(x):
            x = [0, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 5 for c in x), 0]
            return [((x[i], x[j], x[k]), toxicity.DECAY ** (k - i + 1)) for i in range(len(x)) for j in range(i + 1, len(x)) for k in range(j + 1, min(len(x), i + toxicity.SPAN))]

        norm = lambda x: sum(w * w for _, w in triples(x)) ** 0.5
        return sum(w * v for t, w in triples(a) for u, v in triples(b) if t == u) / (norm(a) * norm(b))

    table = toxicity.dense(units)
    got = toxicity.weighed(units, table)
    assert np.allclose(got, [[naive(a, b) for b in units] for a in units], atol=1e-5)
    assert naive("idiot", "idixot") > 3 * naive("moron", "idiot")


def test_toxicity_on_held_out_documents(spark):
    """About a twelfth of the toxic labels stand on documents without a word that other toxic documents share."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.in_fold("doc_id", 3, 1)).collect()
    caught = sum(r.predicted for r in rows if r.toxic)
    assert caught >= 0.9 * sum(r.toxic for r in rows) and caught >= 0.8 * sum(r.predicted for r in rows)


def test_toxicity_of_odd_texts(spark):
    """One value for each text, whatever it is: empty, null, signs only, very long, spelled out over lines."""
    table = np.zeros(1 << 3 * toxicity.SYMBOLS, np.float32)
    for _, keys, w in toxicity.features(["idiot"]):
        table[keys[0]] += w.astype(np.float32)
    model = toxicity.Model(table, 0.0, 1.0, 0.0, -3.0)
    texts = ["you idiot", "IDIOT.\nx", "i d i o t", "i\nd i\no t", "i.d.i.o.t", "a\tidiot b", "x " * 200_000 + "idiot", "--- !!", "", None, "\n\n"]
    import pyarrow as pa

    got = toxicity.document_values(pa.array(texts), model)
    assert (got[:7] > 0.9).all() and (got[7:] == -3.0).all()
    whole = [max((float(model.values([p])[0]) for w in toxicity.words(t or "") for p in toxicity.pieces(w)), default=-3.0) for t in texts]
    assert np.allclose(got, whole)
    docs = spark.createDataFrame([(1, "x", "a"), (None, None, "b")], "doc_id long, text string, score string")
    assert [tuple(r) for r in toxicity.keep_clean(docs, model, 2.0).collect()] == [(1, "x", "a"), (None, None, "b")]
    assert toxicity.scored(docs.limit(0), model).count() == 0 and toxicity.keep_clean(docs.limit(0), model).count() == 0


def test_toxicity_units_are_the_same_in_training_and_scoring():
    import pyarrow as pa

    for text in ("you f.o.o bar", "A b c d. E!f (x-y) end.", "one.\ntwo? three!", "x..y ... z", "w" * 90 + ".v"):
        units = {u for s in toxicity.sentences_of(text) for u in s}
        assert units == {p for w in toxicity.words(text) for p in toxicity.pieces(w)}
    assert toxicity.sentences_of("you f.o.o bar. Next one") == [["you", "foo", "bar"], ["next", "one"]]
    r = random.Random(4)
    plain = ["good", "day", "to", "all", "of", "you", "here", "now"]
    rows = [(" ".join(r.choice(plain) for _ in range(12)) + (" z.u.r.g." if k % 4 == 0 else "."), int(k % 4 == 0)) for k in range(160)]
    model = toxicity.fit(rows)
    docs = [(toxicity.sentences_of(t), y) for t, y in rows]
    naive = [max(float(model.values([u])[0]) for s in x for u in s) for x, _ in docs]
    got = toxicity.document_values(pa.array([t for t, _ in rows]), model)
    assert np.allclose(got, naive)
    assert [int(x >= 0.7) for x in model.score(got)] == [y for _, y in rows]


def test_toxicity_threshold_equals_brute_force():
    r = random.Random(6)
    for _ in range(50):
        v = np.array([r.randint(0, 9) / 2 for _ in range(30)])
        y = np.array([int(r.random() < 0.1 + x / 8) for x in v])
        if not y.any():
            continue
        stands = (r.choice([1.0, 3.0]), 1.0)
        w = np.where(y == 1, stands[1], stands[0])
        f = {x: 2 * w[(v >= x) & (y == 1)].sum() / (w[v >= x].sum() + w[y == 1].sum()) for x in v}
        at = toxicity.threshold(v, y, stands)
        assert 2 * w[(v >= at) & (y == 1)].sum() / (w[v >= at].sum() + w[y == 1].sum()) == pytest.approx(max(f.values()))


def test_toxicity_bound_keeps_the_rate(spark):
    """Words that a tenth of their documents' labels call toxic score about a tenth, however few rows the bound leaves."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(k, " ".join(word() for _ in range(20)), int(r.random() < 0.1)) for k in range(3000)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    for bound in (3000, 150):
        model = toxicity.train(docs, labels, max_rows=bound)
        mean = toxicity.scored(docs, model).where("crc32(cast(doc_id as string)) % 3 = 1").agg({"score": "avg"}).first()[0]
        assert 0.05 < mean < 0.2


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(5)], "doc_id long, text string")
    for rows in ([], [(k, 0) for k in range(5)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {x.predicted for x in toxicity.scored(docs, model).collect()} == {0}


def test_license_scan(spark):
    rows = [(1, "text\nReleased under the MIT License.\nmore", 1), (2, "This work is licensed under the GNU General Public License version 3. And so on", 1), (3, "the license of this text", 1), (None, None, 1), (4, "", 1), (5, "licensed under CC BY-NC 4.0.", 1), (5, "licensed under CC BY-NC 4.0.", 1), (6, "Licensed under the MIT License.", 1), (7, "Released under the GNU License.", 1), (8, "x " * 20_000 + "Released under the MIT License", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    got = sorted((r.doc_id, r.license, r.differences, r.start) for r in license_scan.scan(docs).collect())
    assert got == [(1, "MIT", 0, 5), (2, "GPL-3.0", 0, 0), (5, "CC-BY-NC-4.0", 0, 0), (5, "CC-BY-NC-4.0", 0, 0), (6, "MIT", 1, 0), (8, "MIT", 0, 40_000)]
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_license_scan_finds_wrapped_notices(mark):
    import textwrap

    s = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        if name.endswith(("-SPDX", "-title")):
            continue
        lines = textwrap.wrap(f"Some code here; {text} You may not use it otherwise.", 72)  # also at hyphens
        whole = "int a;\n" + "\n".join(mark + x for x in lines) + "\nint b;"
        assert [(f[1], f[2]) for f in s.scan(whole)] == [(name, 0)]
        changed = whole.replace("License", "Licence", 1) if name in ("CC-BY-SA-4.0", "MPL-2.0") else whole.replace("software", "programs", 1)
        assert [f[1] for f in s.scan(changed)] == [name]
    both = "\n".join([x + "." for x in license_scan.TEMPLATES.values()] * 3)
    assert collections.Counter(f[1] for f in s.scan(both)) == dict.fromkeys(license_scan.TEMPLATES, 3)


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        (license_scan.TEMPLATES["GPL-3.0-notice"].replace("GNU", "GNU Library"), []),
        ("Not licensed under CC BY-NC 4.0.", []),
        ("It is not released under the MIT License.", []),
        ("It is not. Released under the MIT License.", ["MIT"]),
        ("Licensed under CC BY-NC 4.0 ND", []),
        ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-\n * ShareAlike 4.0 International License", ["CC-BY-SA-4.0"]),
        ("Released under the MIT Li-\n# cense.", ["MIT"]),
        ("MIT License\n\nCopyright", ["MIT-title"]),
        ("# SPDX-License-Identifier: MIT", ["MIT-SPDX"]),
        ("SPDX-License-Identifier: LGPL-3.0-only", ["LGPL-3.0-only-SPDX"]),
        ("GNU Lesser General Public License v3", ["LGPL-3.0-title"]),
        ("ISC License", ["ISC-title"]),
        ("BSD 3-Clause License", ["BSD-3-Clause-title"]),
        ("BSD 2-Clause License", ["BSD-2-Clause-title"]),
    ],
)
def test_license_scan_tells_licenses_apart(spark, text, want):
    assert [f[1] for f in license_scan.Scanner(license_scan.TEMPLATES).scan(text)] == want
    assert [r.license for r in license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == want


def edits(a, b, names=(), most=99):
    """Plain edit distance of words from b to a; words in names cost over most."""
    price = [most + 1 if x in names else 1 for x in b]
    d = list(range(len(a) + 1))
    for x, c in zip(b, price):
        p, d[0] = d[0], d[0] + c
        for j, y in enumerate(a, 1):
            p, d[j] = d[j], min(d[j] + c, d[j - 1] + 1, p + c * (x != y))
    return d[-1]


def test_license_scan_equals_brute_force():
    templates = {"a": "red green blue black red white", "b": "green grey blue", "c": "pink red blue", "d": "gold"}
    names = {"b": {"grey"}}
    s = license_scan.Scanner(templates, 0.34, names)
    assert s.allowed == [2, 1, 1, 0]
    r = random.Random(2)
    vocabulary = "red green blue black white grey pink gold other".split()
    seen = collections.Counter()
    for _ in range(400):
        own = [r.choice(vocabulary) for _ in range(r.randint(0, 14))]
        text = " ".join(own)
        free, finds = set(range(len(own))), []
        for start, name, n, alone, given, wording in s.scan(text):
            k = len(text[:start].split())
            run = range(k, k + len(wording.split()))
            assert free.issuperset(run)  # finds don't overlap
            free.difference_update(run)
            finds.append((name, n, wording))
        for name, n, wording in finds:
            k = s.licenses.index(name)
            assert edits(wording.split(), s.words[k], s.names[k], s.allowed[k]) == n <= s.allowed[k]
        for k in range(len(s.words)):  # and each run that is near enough meets one
            for i in range(len(own)):
                for j in range(i + 1, len(own) + 1):
                    if free.issuperset(range(i, j)):
                        assert edits(own[i:j], s.words[k], s.names[k], s.allowed[k]) > s.allowed[k]
        seen.update(f[:2] for f in finds)
    assert len(seen) > 6


def test_best_run_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        own, wording = ([r.choice("abc") for _ in range(r.randint(1, 9))] for _ in range(2))
        at, allowed, names = r.randrange(len(own)), r.randint(0, 3), frozenset(r.sample("abc", r.randint(0, 1)))
        runs = [(edits(own[i:j], wording, names, allowed), abs(j - i - len(wording)), i, j) for i in range(at + 1) for j in range(at + 1, len(own) + 1)]
        want = min((x for x in runs if x[0] <= allowed), default=None)
        assert license_scan.best_run(own, at, wording, allowed, names) == want


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = m[1].translate(LOW), m[2]
    best = None
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_filter_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    extra = [(None, None), (1, "no scheme"), (1, "HTTP://A.Example.ORG/es/9?x#y"), (5000, "http://example.org"), (5001, "http://org/"), (5002, "a://b://c/d"), (5003, "http://badexample.org/es/x")]
    pages = pages.union(spark.createDataFrame(extra, "page_id long, url string"))
    rows = pages.collect()
    tokens = {r.url: frozenset(t) for r, t in zip(rows, (x.t for x in pages.select(url_rules.url_tokens(pages.url).alias("t")).collect()))}
    told = [(tokens[r.url], brute_url(r.url)[2][0]) for r in rows if brute_url(r.url)[2]]
    import itertools

    count, by = collections.Counter(), collections.Counter()
    for items, verdict in told:
        for n in range(1, len(items) + 1):
            for s in itertools.combinations(sorted(items), n):
                count[s] += 1
                by[s, verdict] += 1
    need = int(np.ceil(0.01 * len(told)))
    rules = [(s, v, n / count[s], n / len(told)) for (s, v), n in by.items() if n >= need and n / count[s] >= 0.9]
    want = []
    for r in rows:
        host, path, best = brute_url(r.url)
        fits = [(c, s, len(t), " ".join(t), v) for t, v, c, s in rules if set(t) <= tokens[r.url]]
        want.append((r.page_id, host, path, best and best[1], best[0] if best else max(fits)[4] if fits else "allow"))
    got = [tuple(r) for r in url_rules.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert url_rules.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(0)
    vectors = [(int(k), [int(x) for x in r.integers(-60, 60, 32)]) for k in range(300)] + [(400, [1, 2]), (401, [3, 4]), (None, [1] * 32), (402, None), (20, [7] * 32), (403, []), (2**40, [2**40] * 32)]
    df = spark.createDataFrame([(k, v, 1) for k, v in vectors], "vec_id long, q array<long>, score int")
    for block in (1 << 24, 1000):
        got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, block_bytes=block).collect()
        want = []
        for k, v in vectors:
            if k is not None and v is not None and k % 20 == 0:
                s = sorted((-sum(x * y for x, y in zip(v, w)), n) for n, w in vectors if n is not None and w is not None and len(w) == len(v) and n != k)[:5]
                want += [(k, i + 1, n, max(-(2**63), min(2**63 - 1, -x))) for i, (x, n) in enumerate(s)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_vectors_with_null_components_take_no_part(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, None), (4, [0.51, -0.01])], "vec_id long, embedding array<float>")
    got = df.where(topk.usable(df.embedding)).select("vec_id", topk.quantised(df.embedding).alias("q")).collect()
    assert [(r.vec_id, r.q) for r in got] == [(4, [32, -1])]


def test_sql_agrees(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in SQL.items():
        rel = con.sql(sql)
        want = rel.fetchall()
        got = QUERIES[name](spark, sf).select(*rel.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want), name
