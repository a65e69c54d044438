"""Cross-tokenizer alignment against a plain version that compares all tokens of a text with each other."""

import collections
import hashlib
import json
import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fathom.llm import common, token_alignment
from fathom.llm.queries import QUERIES, tokenizer_path
from fathom.llm.token_files import byte_symbols

from .test_text import SAMPLES

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text as (id, start, end) of A and of B; none where the bytes differ."""
    a, b = Tokenizer.from_file(tokenizer_path(A_FILE)), SentencePieceProcessor(model_file=tokenizer_path(B_FILE))
    a.encode_special_tokens = True
    names = {i: x for x, i in json.load(open(tokenizer_path(A_FILE), encoding="utf-8"))["model"]["vocab"].items()}
    symbols = byte_symbols()

    def run(text):
        out = []
        of_a = [(i, bytes(symbols[c] for c in names[i])) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        of_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        for ids in (of_a, of_b):
            at, rows = 0, []
            for i, x in ids:
                rows.append((i, at, at + len(x)))
                at += len(x)
            out.append(rows)
        raw = (" " + (text or "")).encode()
        return out if text and all(b"".join(x for _, x in ids) == raw for ids in (of_a, of_b)) else [[], []]

    return run


def brute(rows, plain):
    """The contract's columns, by comparing all pairs of tokens of each text."""
    found, count = [], collections.Counter()
    for d, text in rows:
        a, b = plain(text)
        links = [(i, k) for i, s, e in a for k, f, g in b if s < g and f < e]
        count.update(links)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        shown = [",".join(str(i) for i, _, e in a if x < e <= y) + "|" + ",".join(str(i) for i, _, e in b if x < e <= y) for x, y in zip([0, *ends], ends)]
        found.append((d, len(a), len(b), len(ends), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""))
    best = collections.defaultdict(int)
    for (_, k), n in count.items():
        best[k] = max(best[k], n)
    return [(d, na, nb, ng, len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha) for d, na, nb, ng, x, sha in found]


def test_random_texts(spark, plain):
    r = random.Random(5)
    texts = ["".join(r.choice([*SAMPLES, " the", " of", "\nand"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate([None, "", " ", "▁", "word " * 400, "x" * 900, *texts, *texts[:9]])] + [(None, "a text"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n_a int, chunk int").repartition(3)
    for size in (1 << 20, 300):
        got = token_alignment.align(docs, tokenizer_path(A_FILE), tokenizer_path(B_FILE), chunk_bytes=size).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute(rows, plain), key=str)


def test_no_rows_and_no_tokens(spark):
    args = tokenizer_path(A_FILE), tokenizer_path(B_FILE)
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), *args).collect() == []
    got = token_alignment.align(spark.createDataFrame([(1, None), (2, "a▁b")], "doc_id long, text string"), *args).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark, sf, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    short = sorted(rows, key=lambda x: len(x[1] or ""))[:120]
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_token_alignment"](spark, sf).collect()}
    assert len(got) == len(rows)
    for want in brute(short, plain):  # counts over the corpus are in test_random_texts
        assert got[want[0]][:5] == want[:5] and got[want[0]][7] == want[7]
    assert sum(x[4] for x in got.values()) <= sum(x[6] for x in got.values())


def test_row_group_of_each_chunk(spark, tmp_path, monkeypatch):
    """A row group is held in memory, as it is written and as it is read: one chunk, not all of a task's."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    docs = spark.createDataFrame([(k, f"{k} some words " * 9) for k in range(40)], "doc_id long, text string").repartition(2)
    assert token_alignment.align(docs, tokenizer_path(A_FILE), tokenizer_path(B_FILE), chunk_bytes=300).count() == 40
    files = [pq.ParquetFile(x).metadata for x in tmp_path.glob("table-*/*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > len(files) and set(groups) == {1}


def test_slices_of_a_chunk(plain):
    """Any slice of units and links gives the same chunk."""
    aligner = token_alignment.loaded(tokenizer_path(A_FILE), tokenizer_path(B_FILE))
    texts = pa.array([None, "", "a", "▁x", "one two one\n\nthree  four", "one " * 50, "\x00 z", "two three"])
    ids = pa.array(range(len(texts)))
    whole, *others = [{k: list(x) for k, x in aligner.chunk(ids, texts, most).items()} for most in (1 << 20, 1, 3, 40)]
    assert all(x == whole for x in others)
    assert whole["n_links"][5] == sum(whole["times"][whole["ends"][4] : whole["ends"][5]])


PEAK = """
import re, sys
import pyarrow.parquet as pq
from fathom.llm import token_alignment as t
aligner, table = t.loaded(*sys.argv[1:3]), pq.read_table(sys.argv[3], columns=["doc_id", "text"])
for k in (0, 2000):
    part = table.slice(k, 2000)
    aligner.chunk(part["doc_id"].combine_chunks(), part["text"].combine_chunks())
print(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1])
"""


def test_memory_of_a_chunk():
    """Several workers share an executor: chunks of the usual size must not take half a GB beyond the tokenizers."""
    args = tokenizer_path(A_FILE), tokenizer_path(B_FILE), "/root/testdata/sf0.1/documents.parquet"
    out = subprocess.run([sys.executable, "-c", PEAK, *args], capture_output=True, text=True, check=True, timeout=300, cwd=Path(__file__).parents[2])
    assert int(out.stdout.split()[-1]) < 650 * 1024
