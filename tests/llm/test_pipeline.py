"""The pipeline's stages against plain versions of their decisions."""

import hashlib

import corpus_pipeline
from fathom.llm import simhash, toxicity
from fathom.llm.queries import tokenizer_path

from .test_dedup import shingle_sets
from .test_text import brute_contamination


def test_stages_follow_each_other(spark, sf):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    groups = {r.doc_id: r.component_id for r in simhash.similar_documents(docs.where(~docs.doc_id.isin(list(toxic)))).collect()}
    sets = shingle_sets([t for _, t in rows])
    place = {d: k for k, (d, _) in enumerate(rows)}
    for k, a in enumerate(sets):  # brute force: all that are clearly similar are in one group, and groups hold nothing else
        like = [m for m, b in enumerate(sets) if m < k and len(a & b) >= 0.84 * len(a | b)]
        assert all(groups[rows[k][0]] == groups[rows[m][0]] for m in like)
    for d, c in groups.items():
        if c != d:
            assert any(len(sets[place[d]] & sets[place[e]]) >= 0.7 * len(sets[place[d]] | sets[place[e]]) for e, x in groups.items() if x == c and e != d)
    rows = [x for x in rows if groups[x[0]] == x[0]]
    size = 50
    first = {}
    for d, t in rows:
        raw = t.encode()
        for a in range(len(raw) - size + 1):
            first[raw[a : a + size]] = min(d, first.get(raw[a : a + size], d))
    cut = []
    for d, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - size + 1):
            if first[raw[a : a + size]] < d:
                gone[a : a + size] = b"\1" * size
        kept = bytes(x for x, y in zip(raw, gone) if not y).decode("utf-8", "ignore") if any(gone) else t
        if kept or not t:
            cut.append((d, kept))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [x for x, r in zip(cut, brute_contamination(cut, items)) if not r[5]]
    sp = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d, t in clean:
        ids = sp.encode(t)
        want.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(sp.decode(ids).encode())))
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "repeated passages", "decontamination", "encoding"]
