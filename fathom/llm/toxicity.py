"""Toxicity: a support vector machine with a gapped subsequence string kernel and Nystroem landmarks.

A unit (a word, without signs inside it; a run of single letters counts as one word, too) has a feature for each three
characters that occur in it in this order within `span` places, weighted by decay ** (places they span), so gaps and
inserted characters weaken a match but do not end it. The kernel of two units is the inner product of their features,
each divided by a norm that depends on the length alone. Landmarks are units; the Nystroem map takes a unit to its kernel
values with them, whitened; the machine is linear there. As all of this is linear in the features, a trained machine is
one table with a weight for each three characters.

Training is by sentences with the label of their document. All sentences of clean documents are clean, but for words that
toxic documents have far more often; of a toxic document at least one sentence is toxic, and in each round the one with the
highest value stands for it. A sentence's value is that of its highest unit, as insults are single words that hide among
clean ones; a document's is that of its highest sentence. So this is a model of words: an insult of several clean words is
not learnt. The values that each document got from a machine fitted without it give the curve that turns values into scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, distinct_words, hand_back

SYMBOLS = 5  # bits for a character
SPAN, DECAY = 6, 0.7
LONGEST = 32  # longer units are judged in overlapping pieces
SPELLED = re.compile(r"(?: \w[.,!?;:]?){3,}(?= |$)")
MAYBE_SPELLED = r"(?:^|[ \n])\S[.,!?;:]?[ \n]\S[.,!?;:]?[ \n]\S[.,!?;:]?(?:[ \n]|$)"
#: Signs within a word end no sentence, so a word with dots in it is the same unit here and where texts are scored.
SENTENCE_END = re.compile(r"[.!?]+(?=\s|\Z)|\n+")
SIGNS = re.compile(r"[\W_]+")
#: A unit is a candidate for an insult if toxic documents have it exp(LEAN) = ten times as often as clean ones; PRIOR weighs the
#: logarithm of how many toxic documents have it, POWER flattens how often it was chosen. Set on the training folds of sf0.1.
LEAN, PRIOR, POWER = 2.3, 0.4, 0.3
LEAST_SHARE = 0.25
STEPS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]


def coded(units: list[str]) -> np.ndarray:
    """Symbols of units of one length, with the edge of a word (0) at both ends: a-z have their own, other characters share
    the rest of the alphabet by their code."""
    n = len(units[0])
    raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(units), n).astype(np.int64)
    letter = (raw >= 97) & (raw < 123)
    out = np.zeros((len(units), n + 2), np.int64)
    out[:, 1:-1] = np.where(letter, raw - 96, 27 + raw % 5)
    return out


def pieces(word: str) -> list[str]:
    """A lower-cased word without signs, cut into overlapping pieces if it is long."""
    unit = SIGNS.sub("", word)
    if len(unit) <= LONGEST:
        return [unit] if unit else []
    return [unit[k : k + LONGEST] for k in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def words(text: str) -> list[str]:
    """Lower-cased words; runs of at least three single letters follow as words of their own."""
    text = text.lower()
    return text.split() + [x.group() for x in spelled(text)]


def spelled(text: str) -> Iterator[re.Match[str]]:
    return SPELLED.finditer(" " + text.replace("\n", " "))


def features(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For units of one length at a time: their places, the keys of their features (units by features), and weights."""
    by: dict[int, list[int]] = {}
    for k, x in enumerate(units):
        by.setdefault(len(x), []).append(k)
    for n, places in by.items():
        for a in range(0, len(places), 4096):
            at = places[a : a + 4096]
            c = coded([units[k] for k in at])
            keys, weights = [], []
            for s, t, w in STEPS:
                if n + 2 > t:
                    keys.append(c[:, : n + 2 - t] << 2 * SYMBOLS | c[:, s : n + 2 - t + s] << SYMBOLS | c[:, t:])
                    weights.append(np.full(n + 2 - t, w))
            w = np.concatenate(weights)
            yield np.array(at), np.concatenate(keys, axis=1), w / np.sqrt((w * w).sum())


def weighed(units: list[str], table: np.ndarray) -> np.ndarray:
    """Inner products of the units' features with a table (columns: several tables at once)."""
    out = np.zeros((len(units), *table.shape[1:]))
    for at, keys, w in features(units):
        for k in range(0, len(at), max(1, 2_000_000 // (keys.shape[1] * int(np.prod(table.shape[1:], initial=1))))):
            part = slice(k, k + max(1, 2_000_000 // (keys.shape[1] * int(np.prod(table.shape[1:], initial=1)))))
            out[at[part]] = np.tensordot(table[keys[part]], w, axes=(1, 0)) if table.ndim == 1 else np.einsum("ijk,j->ik", table[keys[part]], w)
    return out


def dense(units: list[str]) -> np.ndarray:
    """The units' features as columns."""
    out = np.zeros((1 << 3 * SYMBOLS, len(units)), np.float32)
    for at, keys, w in features(units):
        for row, k in zip(keys, at, strict=True):
            np.add.at(out[:, k], row, w.astype(np.float32))
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 12) -> np.ndarray:
    """Weights (the last is the offset) of the linear machine with squared hinge loss, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    keep = np.r_[np.full(len(w) - 1, ridge), 1e-6]
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(x[active].T @ xa + np.diag(keep), xa.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def variant(unit: str, n: int) -> str:
    """The unit with a letter put in, as insults are written to get past word lists; the place and the letter follow from n."""
    h = crc32(f"{unit}{n}".encode())
    k = 1 + h % (len(unit) - 1)
    return unit[:k] + chr(97 + (h >> 8) % 26) + unit[k:]


@dataclass
class Model:
    table: np.ndarray
    offset: float
    slope: float
    shift: float
    lowest: float

    def values(self, units: list[str]) -> np.ndarray:
        return weighed(units, self.table) + self.offset

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def of_words(self, words: list[str], most: int, keep: bool = True) -> list[float]:
        """The highest value of the pieces of each word, -inf without pieces."""
        if not hasattr(self, "cache"):
            self.forget()
        got = list(map(self.cache.get, words))
        missing = []
        for k in [k for k, x in enumerate(got) if x is None]:
            if (x := self.older.get(words[k])) is None:
                missing.append(k)
            else:
                got[k] = self.cache[words[k]] = x
        parts = [pieces(words[k]) if not keep else [p for w in words[k].lower().split() for p in pieces(w)] for k in missing]
        sizes = np.array([len(x) for x in parts], np.int64)
        values = np.r_[self.values([p for x in parts for p in x]), -np.inf]
        best = np.full(len(parts), -np.inf)
        if sizes.any():
            starts = (np.cumsum(sizes) - sizes)[sizes > 0]
            best[sizes > 0] = np.maximum.reduceat(values[:-1], starts)
        for k, x in zip(missing, best.tolist(), strict=True):
            got[k] = x
            if keep and len(words[k]) < 64:
                self.cache[words[k]] = x
        if len(self.cache) > most:
            self.cache, self.older = {}, self.cache
        return got

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def logistic(value: np.ndarray, y: np.ndarray, stands: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Slope (at least a little above 0) and shift of the curve, by Newton steps with smoothed targets.

    stands: for how many rows a clean and a toxic row stand; the curve has the rate of the rows they stand for.
    """
    n1, n0 = int(y.sum()), int((1 - y).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, stands[1], stands[0])
    weight = weight / weight.mean()
    w, x = np.array([1.0, 0.0]), np.stack([value, np.ones(len(value))], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (weight * (p - target)) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def threshold(value: np.ndarray, y: np.ndarray, stands: tuple[float, float]) -> float:
    """The value from which on texts are taken for toxic: where precision and recall have the highest harmonic mean."""
    order = np.argsort(-value, kind="stable")
    v, w, y = value[order], np.where(y == 1, stands[1], stands[0])[order], y[order]
    right, taken, all_toxic = np.cumsum(w * y), np.cumsum(w), (w * y).sum()
    f = np.where(np.append(v[1:] != v[:-1], True), 2 * right / (taken + all_toxic), -1.0)
    k = int(np.argmax(f))
    return float((v[k] + v[min(k + 1, len(v) - 1)]) / 2)


Sentences = list[list[str]]  # the distinct units of each sentence of a document


def sentences_of(text: str | None) -> Sentences:
    """The distinct units of each sentence."""
    out = []
    for s in SENTENCE_END.split(text or ""):
        units = list(dict.fromkeys(p for w in words(s) for p in pieces(w)))
        if units:
            out.append(units)
    return out


def machine(docs: list[tuple[Sentences, int]], landmarks: int = 192, negatives: int = 20_000, rounds: int = 6, ridge: float = 1.0) -> Model | None:
    """A machine from labelled documents; its values are not scores yet. None without both labels.

    negatives bounds how many units of clean sentences a round weighs; those that the machine of the round before took for
    toxic come first.
    """
    n1, n = sum(y for _, y in docs), len(docs)
    if not 0 < n1 < n:
        return None
    clean: Counter[str] = Counter()
    toxic: Counter[str] = Counter()
    for sentences, y in docs:
        (toxic if y else clean).update({u for s in sentences for u in s})
    #: Log odds of a unit in toxic against clean documents. Most words are in both; those that toxic documents have much
    #: more often may be insults, also where a clean document quotes one.
    lean = {u: float(np.log((k + 0.5) / (n1 + 1)) - np.log((clean[u] + 0.5) / (n - n1 + 1))) for u, k in toxic.items()}
    new = sorted(u for u, x in lean.items() if x > LEAN or u not in clean)
    order = sorted(set(clean) - set(new), key=lambda u: crc32(u.encode()))

    # The first round: characters in a row that many more toxic than clean documents hold.
    rows_of: dict[str, np.ndarray] = {}
    by: dict[int, list[str]] = {}
    for u in dict.fromkeys([*clean, *toxic]):
        by.setdefault(len(u), []).append(u)
    for units in by.values():
        c = coded(units).astype(np.int32)
        rows_of |= zip(units, c[:, :-2] << 2 * SYMBOLS | c[:, 1:-1] << SYMBOLS | c[:, 2:], strict=True)
    seen = np.zeros((2, 1 << 3 * SYMBOLS))
    for sentences, y in docs:
        if sentences:
            seen[y, np.concatenate([rows_of[u] for s in sentences for u in s])] += 1  # once for each document
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n - n1 + 1))
    prior = {u: PRIOR * float(np.log(toxic[u])) for u in new}  # a unit that many toxic documents share is likelier meant
    value = {u: float(odds[rows_of[u]].mean()) + prior[u] for u in new}
    del rows_of
    hard: list[str] = []
    model = None
    for _ in range(rounds):
        chosen: Counter[str] = Counter()
        for sentences, y in docs:
            if y and (best := max(((value[u], u) for s in sentences for u in s if u in value), default=None)):
                chosen[best[1]] += 1
        pos = list(chosen)
        neg = list(dict.fromkeys(hard[: negatives // 2] + order))[:negatives]
        marks = [u for u, _ in chosen.most_common(landmarks // 2)]
        marks += [u for u in neg if u not in chosen][: landmarks - len(marks)]
        phi = dense(marks)
        gram = (phi.T @ phi).astype(np.float64)
        e, v = np.linalg.eigh(gram)
        white = v[:, e > 1e-6] / np.sqrt(e[e > 1e-6])
        chosen.update({v: 0.25 * chosen[u] for u in pos if len(u) > 3 for v in (variant(u, 0), variant(u, 1)) if v not in clean})
        pos = list(chosen)
        units = pos + neg
        x = weighed(units, phi) @ white
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        weight = np.r_[np.array([chosen[u] for u in pos], float) ** POWER, np.ones(len(neg))]
        weight[: len(pos)] *= 0.5 * len(neg) / weight[: len(pos)].sum()
        w = squared_hinge(x, y, weight, ridge)
        model = Model((phi @ (white @ w[:-1])).astype(np.float32), float(w[-1]), 1.0, 0.0, 0.0)
        value = {u: v + prior[u] for u, v in zip(new, model.values(new).tolist(), strict=True)}
        all_clean = model.values(order)
        hard = [order[k] for k in np.argsort(-all_clean)[: negatives // 2] if all_clean[k] > -1]
    return model


def tops(model: Model, docs: list[tuple[Sentences, int]]) -> np.ndarray:
    """The highest value of any sentence of each document; NaN without units."""
    flat = list(dict.fromkeys(u for sentences, _ in docs for s in sentences for u in s))
    value = dict(zip(flat, model.values(flat).tolist(), strict=True))
    return np.array([max((value[u] for s in sentences for u in s), default=np.nan) for sentences, _ in docs])


def without(docs: list[tuple[Sentences, int]], fold: int, folds: int) -> tuple[Model | None, np.ndarray]:
    """The machine of all documents outside a fold, and the fold's values (fold = folds: all documents, no values)."""
    model = machine([d for k, d in enumerate(docs) if k % folds != fold])
    held = docs[fold::folds] if fold < folds else []
    return model, tops(model, held) if model and held else np.full(len(held), np.nan)


def calibrated(parts: dict[int, tuple[Model | None, np.ndarray]], labels: list[int], stands: tuple[float, float], limit: float) -> Model:
    """The machine of all documents, with the curve of the values that each document got from a machine without it.

    The curve is the logistic one, moved so that it reaches the limit at the threshold, where precision and recall are in
    balance; not moved where the threshold's own share of toxic texts is below LEAST_SHARE, as values then tell little.

    Without both labels, or without values, the score is the smoothed share of toxic rows for every text.
    """
    folds = len(parts) - 1
    y, value = np.array(labels, np.int64), np.full(len(labels), np.nan)
    for k in range(folds):
        value[k::folds] = parts[k][1]
    model, seen = parts[folds][0], ~np.isnan(value)
    if model is None or len(set(y[seen].tolist())) < 2:
        share = (stands[1] * y.sum() + 1) / (stands[1] * y.sum() + stands[0] * (1 - y).sum() + 2)
        return Model(np.zeros(1 << 3 * SYMBOLS, np.float32), 0.0, 1e-3, float(np.log(share / (1 - share))), 0.0)
    model.lowest = float(np.nanmin(value))
    value = np.where(seen, value, model.lowest)
    model.slope, model.shift = logistic(value, y, stands)
    at = threshold(value, y, stands)
    if model.score(np.array(at)) >= LEAST_SHARE:
        model.shift = float(np.log(limit / (1 - limit))) - model.slope * at
    return model


def fit(rows: Iterable[tuple[str | None, int]], folds: int = 3, stands: tuple[float, float] = (1.0, 1.0), limit: float = 0.7) -> Model:
    """A machine from labelled texts (text, toxic 0/1), given in an order that does not depend on the label. stands: see logistic()."""
    docs = [(sentences_of(text), int(y)) for text, y in rows]
    return calibrated({k: without(docs, k, folds) for k in range(folds + 1)}, [y for _, y in docs], stands, limit)


def document_values(texts: pa.Array, model: Model, most: int = 50_000) -> np.ndarray:
    """The highest value of any unit of each text; the lowest value known from training for a text without units.

    The model keeps the values of the words that it has seen, in two generations of at most `most` words.
    """
    texts = pc.fill_null(texts, "")
    found, index, edges = distinct_words(texts)
    value = np.array(model.of_words(found, most), np.float64)
    out = np.maximum.reduceat(value[index], edges[:-1]) if len(texts) else np.zeros(0)
    runs = [(k, x.group()) for k in np.flatnonzero(pc.match_substring_regex(texts, MAYBE_SPELLED).to_numpy(zero_copy_only=False)) for x in spelled(texts[k].as_py().lower())]
    if runs:
        np.maximum.at(out, [k for k, _ in runs], model.of_words([x for _, x in runs], most, keep=False))
    return np.where(out > -np.inf, out, model.lowest)


def in_fold(doc_id: "F.Column", folds: int, held: int):
    """Whether crc32(doc_id as text) mod folds is the held-out remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == held, F.lit(False))


def shared_units(column: pa.Array) -> list[Sentences]:
    """The sentences of each document as lists; equal units are one object, which takes little memory."""
    coded = column.flatten().flatten().dictionary_encode()
    known, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    docs, sentences = (np.cumsum(np.r_[0, pc.list_value_length(x).to_numpy()]).tolist() for x in (column, column.flatten()))
    return [[[known[k] for k in at[sentences[s] : sentences[s + 1]].tolist()] for s in range(a, b)] for a, b in zip(docs, docs[1:], strict=False)]


FITTED = "fold long, empty boolean, model binary, offset double, held array<double>, labels array<int>"


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, max_rows: int = 2000, tuning: int = 3, limit: float = 0.7) -> Model:
    """Fits on labelled documents outside the held-out fold: of each label at most max_rows, those with the least hashes of
    their ids, with their whole texts. The bound is a parameter; it keeps the fit independent of the corpus. limit is the
    score from which on a text is taken for toxic. Null labels and rows of labels without a document are left out; of repeated
    labels of a document the highest counts, of repeated documents the text that is last in order. The curve of the score is
    weighed to the labels' counts over all data outside the fold, so the bound does not move what a score means.

    Texts are reduced to units where they are. The machines that the curve needs (one without each of `tuning` parts, one of
    all) are fitted in one task each; the driver gets the finished tables.
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds, held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = {r.toxic: r["count"] for r in told.groupBy("toxic").count().collect()}
    ids = []
    for y in (0, 1):
        ids += [(r.doc_id, y) for r in told.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()]
    if not ids:
        return fit([])
    taken = Counter(y for _, y in ids)
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_rows bounds what is sent
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                sentences = [sentences_of(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sentences, pa.list_(pa.list_(pa.string())))], names=["doc_id", "toxic", "sentences"])

    units = bounded_batches(rows).mapInArrow(reduce, "doc_id long, toxic int, sentences array<array<string>>")
    parts = units.select("*", F.explode(F.array(*(F.lit(k).cast("long") for k in range(tuning + 1)))).alias("fold")).repartition(tuning + 1, "fold")

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["toxic"].to_pylist(), shared_units(table["sentences"].combine_chunks()), strict=True), key=lambda r: (crc32(b"%d" % r[0]), r[0]))
        fold = table["fold"][0].as_py()
        model, values = without([(s, y) for _, y, s in rows], fold, tuning)
        hand_back()
        return pa.table({"fold": pa.array([fold], pa.int64()), "empty": pa.array([model is None], pa.bool_()), "model": pa.array([model.table.tobytes() if model else b""], pa.binary()), "offset": pa.array([model.offset if model else 0.0]), "held": pa.array([values], pa.list_(pa.float64())), "labels": pa.array([[y for _, y, _ in rows]], pa.list_(pa.int32()))})

    got = parts.groupBy("fold").applyInArrow(one, FITTED).collect()
    if not got:
        return fit([])
    models = {r.fold: (None if r.empty else Model(np.frombuffer(bytes(r.model), np.float32), r.offset, 1.0, 0.0, 0.0), np.array(r.held, np.float64)) for r in got}
    return calibrated(models, list(got[0].labels), tuple(known[k] / taken[k] if taken[k] else 1.0 for k in (0, 1)), limit)


def scored(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 if score >= limit) of every row. Null texts count as empty; empty texts get the score of
    the lowest value. Ids may be null or repeated; each row is scored by its text alone. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2 << 20):
            score = sent.value.score(document_values(part["text"].combine_chunks(), sent.value))
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "score", "predicted"])
        sent.value.forget()
        hand_back()

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the limit, with all their columns; otherwise as scored()."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2 << 20):
            score = sent.value.score(document_values(part["text"].combine_chunks(), sent.value))
            yield from part.filter(pa.array(score < limit)).to_batches()
        sent.value.forget()
        hand_back()

    return bounded_batches(docs).mapInArrow(run, docs.schema)
