"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hashed parts: the whole word, its first four to eight letters, its last three. Filters of one, two and three words slide over
a whole text; each keeps its greatest activation, and a logistic unit weighs those. Only the windows that win a maximum carry gradients, so training on
whole texts costs what their windows cost. Parts that fewer than LEAST_TEXTS texts of the sample have stay zero: they cannot be learnt.

The fit reads at most SAMPLE_PER_CLASS labelled documents of each class, those of the least hashed doc_id (the documented bound), one row for each
doc_id and for each text, in one task. A fifth of them is not trained on: a logistic regression on its raw scores, classes weighed alike, makes them
probabilities, and it sets a threshold for each language, drawn to the common one where a language has few toxic texts. The model's size does not depend on the corpus. Scoring reads
every text whole, in pieces of CHUNK_WORDS words that overlap by what a filter sees. Labels, language, source and doc_id are no inputs of a score.

Defined results: null and empty texts score as texts without any activation; of several labels of a document the worst counts, of texts that are equal the mean; documents
without a label are scored like the others; without labels of both classes every score is the share of toxic ones (0 without any label); repeated rows
each get their row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

SAMPLE_PER_CLASS = 3000
BITS, SIZE, WIDTHS, FILTERS = 18, 8, (1, 2, 3), 12
EPOCHS, LEAST_STEPS, BATCH, RATE, PENALTY, LEAST_TEXTS = 4, 500, 16, 0.01, 1e-4, 3
CUT = 0.7  # the score from which a text is predicted toxic
SHRINK = 20  # toxic texts of a language that weigh as much as all languages together
CHUNK_WORDS, CACHE_WORDS = 50_000, 400_000
REACH = max(WIDTHS) - 1

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts_of(word: str) -> list[int]:
    """The hashed parts of a word; bucket 0 is left to the empty word that pads texts."""
    code = lambda kind, s: zlib.crc32(s.encode(), kind) % ((1 << BITS) - 1) + 1
    return [code(0, word), *[code(n, word[:n]) for n in range(4, 9) if len(word) > n], code(99, word[-3:])]


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # of each width: words x SIZE x FILTERS
    bias: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    intercept: float = 0.0
    scale: float = 1.0  # from raw scores to log odds
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # by language
    constant: float | None = None  # the score of all texts where nothing could be learnt

    def score(self, raw: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(raw), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.shift, -30, 30)))


def embed(rows: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """The sums of the rows of each word's parts."""
    if not parts:
        return np.zeros((0, rows.shape[1]), np.float32)
    ends = np.cumsum([0, *map(len, parts[:-1])])
    return np.add.reduceat(rows[np.concatenate([np.asarray(p) for p in parts])], ends, axis=0).astype(np.float32)


def activations(embedded: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray]) -> list[np.ndarray]:
    """Of each width the activations at each place but the last REACH ones, which only pad."""
    n = len(embedded) - REACH
    out = []
    for kernel, b in zip(filters, bias):
        z = embedded[:n] @ kernel[0] + b
        for j in range(1, len(kernel)):
            z += embedded[j : n + j] @ kernel[j]
        out.append(z)
    return out


def pooled(ids: list[np.ndarray], vectors: np.ndarray, model: Model) -> np.ndarray:
    """The greatest activation of each filter in each text, 0 at least. ids: rows of vectors, of which row 0 pads."""
    out = np.zeros((len(ids), len(WIDTHS) * FILTERS), np.float32)
    pad = np.zeros(REACH, np.int64)
    chunks = [(i, x[low : low + CHUNK_WORDS], x[low + CHUNK_WORDS : low + CHUNK_WORDS + REACH]) for i, x in enumerate(ids) for low in range(0, len(x), CHUNK_WORDS)]
    at = 0
    while at < len(chunks):
        size, end = 0, at
        while end < len(chunks) and (end == at or size + len(chunks[end][1]) <= CHUNK_WORDS):
            size, end = size + len(chunks[end][1]), end + 1
        flat = np.concatenate([x for _, own, after in chunks[at:end] for x in (own, after, pad[len(after) :])])
        edges = np.cumsum([0, *[n for _, own, _ in chunks[at:end] for n in (len(own), REACH)]])[:-2]  # the last own part ends where z ends
        z = np.concatenate(activations(vectors[flat], model.filters, model.bias), axis=1)
        best = np.maximum.reduceat(z, edges, axis=0)[::2]
        np.maximum.at(out, [i for i, _, _ in chunks[at:end]], best)
        at = end
    return out


def fit(texts: list[str], toxic: np.ndarray, seed: int = 1, trace: list | None = None) -> Model:
    """A model of texts with labels 0 and 1, by Adam on the logistic loss, classes weighed alike. Deterministic."""
    rng, model = np.random.default_rng(seed), Model()
    known: dict[str, int] = {"": 0}
    ids = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
    parts = [[0], *[parts_of(w) for w in list(known)[1:]]]
    seen = np.zeros(1 << BITS, np.int32)
    for x in ids:
        u = np.unique(x)
        if len(u):
            seen[np.unique(np.concatenate([np.asarray(parts[i]) for i in u.tolist()]))] += 1
    used = np.flatnonzero(seen >= LEAST_TEXTS)
    number = np.zeros(1 << BITS, np.int64)  # parts that are not used share row 0, which stays zero
    number[used] = np.arange(1, len(used) + 1)
    parts = [np.unique(number[p])[1 if (number[p] == 0).any() and (number[p] > 0).any() else 0 :] for p in parts]
    sizes = np.array([len(p) for p in parts])
    begins, flat = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts)
    rows = rng.normal(0, 0.1, (len(used) + 1, SIZE)).astype(np.float32)
    rows[0] = 0
    filters = [rng.normal(0, 1 / math.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    state = [rows, *filters, *[np.zeros(FILTERS, np.float32) for _ in WIDTHS], weights, np.zeros(1, np.float32)]
    moments, powers = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    balance = len(toxic) / 2 / np.maximum(1, np.bincount(toxic, minlength=2))
    step = 0
    for _ in range(max(EPOCHS, math.ceil(LEAST_STEPS * BATCH / len(texts)))):  # small samples are read more often
        order, loss = rng.permutation(len(texts)), 0.0
        for low in range(0, len(order), BATCH):
            rows, filters, bias, weights, intercept = state[0], state[1 : 1 + len(WIDTHS)], state[1 + len(WIDTHS) : -2], state[-2], state[-1]
            ups = [np.zeros_like(p) for p in state]
            batch = order[low : low + BATCH]
            own, place = np.unique(np.concatenate([ids[i] for i in batch] + [np.zeros(1, np.int64)]), return_inverse=True)
            take = np.concatenate([flat[begins[w] : begins[w + 1]] for w in own.tolist()])
            edges = np.cumsum([0, *sizes[own][:-1]])
            vectors = np.add.reduceat(rows[take], edges, axis=0)
            up_vectors, at = np.zeros_like(vectors), 0
            for i in batch:
                n = len(ids[i])
                x = np.concatenate([place[at : at + n], np.zeros(REACH, np.int64)])  # own[0] is the pad
                at += n
                z = activations(vectors[x], filters, bias) if n else []
                win = [a.argmax(0) for a in z]
                top = np.concatenate([np.maximum(a[w, np.arange(FILTERS)], 0) for a, w in zip(z, win)]) if n else np.zeros(len(weights), np.float32)
                raw = float(top @ weights + intercept[0])
                p = 1 / (1 + math.exp(-max(-30, min(30, raw))))
                g = (p - toxic[i]) * balance[toxic[i]] / len(batch)
                loss -= math.log(max(1e-9, p if toxic[i] else 1 - p))
                ups[-2] += g * top
                ups[-1] += g
                for k, (a, w) in enumerate(zip(z, win)):
                    f = np.flatnonzero(top[k * FILTERS : (k + 1) * FILTERS] > 0)
                    up = (g * weights[k * FILTERS + f]).astype(np.float32)
                    ups[1 + len(WIDTHS) + k][f] += up
                    for j in range(WIDTHS[k]):
                        word = x[w[f] + j]
                        ups[1 + k][j][:, f] += (vectors[word] * up[:, None]).T
                        np.add.at(up_vectors, word, up[:, None] * filters[k][j][:, f].T)
            np.add.at(ups[0], take, np.repeat(up_vectors, sizes[own], axis=0))
            ups[0][0] = 0
            ups[-2] += PENALTY * weights
            step += 1
            for p, up, m, v in zip(state, ups, moments, powers):
                m *= 0.9
                m += 0.1 * up
                v *= 0.999
                v += 0.001 * up * up
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        if trace is not None:
            trace.append(loss / len(texts))
    model.table[used] = state[0][1:]
    model.filters, model.bias, model.weights, model.intercept = state[1 : 1 + len(WIDTHS)], state[1 + len(WIDTHS) : -2], state[-2], float(state[-1][0])
    return model


class Scorer:
    """Raw scores of texts by a model; embeddings of words are kept, up to a bound."""

    def __init__(self, model: Model):
        self.model, self.known, self.rows = model, {"": 0}, np.zeros((1, SIZE), np.float32)

    def raw(self, texts: list[str]) -> np.ndarray:
        listed = [words_of(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.rows = {"": 0}, np.zeros((1, SIZE), np.float32)
        known = self.known
        new = [w for words in listed for w in words if known.setdefault(w, len(known)) >= len(self.rows)]
        new = list(dict.fromkeys(new))
        self.rows = np.concatenate([self.rows, embed(self.model.table, [parts_of(w) for w in new])])
        ids = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in listed]
        return pooled(ids, self.rows, self.model).astype(np.float64) @ self.model.weights + self.model.intercept


def best_cut(raw: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of the best F1 of `raw at or over the cut is toxic`."""
    order = np.argsort(-raw, kind="stable")
    s, hits = raw[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    lower = np.append(s[1:], s[-1] - 1)
    f1[lower == s] = -1  # equal scores are not parted
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = best[np.argmax((s - lower)[best])]
    return float((s[i] + lower[i]) / 2)


def calibrate(model: Model, raw: np.ndarray, toxic: np.ndarray, langs: list[str]) -> Model:
    """model with scale, shift and the languages' thresholds from texts that it was not trained on."""
    if not 0 < toxic.sum() < len(toxic):
        return model
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    a, b = 1.0, 0.0
    for _ in range(200):  # with a little ridge, by Newton's method in short steps
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = weight * p * (1 - p)
        up = np.array([(weight * (p - toxic) * raw).sum() + 0.02 * a, (weight * (p - toxic)).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.02, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, up)
        a, b = a - min(1.0, max(-1.0, float(step[0]))), b - float(step[1])
    model.scale, model.shift = max(0.05, a), b
    common = (math.log(CUT / (1 - CUT)) - model.shift) / model.scale
    names = np.array(langs)
    for lang in sorted(set(langs)):
        own = names == lang
        n = int(toxic[own].sum())
        if 0 < n < own.sum():
            cut = (n * best_cut(raw[own], toxic[own]) + SHRINK * common) / (n + SHRINK)
            model.thresholds[lang] = float(model.score(np.array([cut]))[0])
    return model


def train_model(ids: list[int], texts: list[str], toxic: np.ndarray, langs: list[str]) -> Model:
    """A calibrated model of distinct texts. A fifth, by a hash of the doc_id, calibrates."""
    if not 0 < toxic.sum() < len(toxic):
        return Model(constant=float(toxic.mean()) if len(toxic) else 0.0)
    aside = np.array([zlib.crc32(f"{i} aside".encode()) % 5 == 0 for i in ids])
    if not 0 < toxic[~aside].sum() < (~aside).sum():
        aside[:] = False
    keep = lambda mask, values: [v for v, m in zip(values, mask) if m]
    model = fit(keep(~aside, texts), toxic[~aside])
    return calibrate(model, Scorer(model).raw(keep(aside, texts)), toxic[aside], keep(aside, langs)) if aside.any() else model


def _to_bytes(m: Model) -> bytes:
    out = io.BytesIO()
    rest = {"intercept": m.intercept, "scale": m.scale, "shift": m.shift, "thresholds": m.thresholds, "constant": m.constant, "learnt": bool(m.filters)}
    np.savez(out, table=m.table, weights=m.weights, rest=np.frombuffer(json.dumps(rest).encode(), np.uint8), **{f"f{i}": x for i, x in enumerate(m.filters)}, **{f"b{i}": x for i, x in enumerate(m.bias)})
    return out.getvalue()


def _from_bytes(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as z:
        rest, n = json.loads(z["rest"].tobytes()), len(WIDTHS)
        learnt = rest.pop("learnt")
        return Model(z["table"], [z[f"f{i}"] for i in range(n)] if learnt else [], [z[f"b{i}"] for i in range(n)] if learnt else [], z["weights"], **rest)


def _fit_group(group: pa.Table) -> pa.Table:
    group = group.sort_by([("doc_id", "ascending")])
    model = train_model(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), group.column("toxic").to_numpy().astype(np.int64), group.column("lang").to_pylist())
    return pa.table({"model": pa.array([_to_bytes(model)], pa.binary())})


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, text, lang and toxic of at most so many labelled documents of each class; one row for each doc_id, and for each text."""
    rated = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    # at most twice per_class rows of two numbers
    chosen = [rated.filter(F.col("_toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    row = F.struct(F.xxhash64("text").alias("h"), "text", "lang")
    one = own.groupBy("doc_id").agg(F.min(row).alias("row"), F.first("_toxic").alias("toxic"))
    same = one.groupBy("row.h", "row.text").agg(F.min(F.struct("doc_id", "row.lang")).alias("d"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return same.select("d.doc_id", "text", "d.lang", "toxic")


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model fitted in one task on labelled_sample, whose bound is per_class."""
    found = labelled_sample(docs, labels, per_class).groupBy().applyInArrow(_fit_group, "model binary").collect()
    return _from_bytes(found[0]["model"]) if found else Model(constant=0.0)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score, predicted (the score is CUT at least), threshold of the row's language and flagged (the score reaches it)."""
    shared = docs.sparkSession.sparkContext.broadcast(_to_bytes(model))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _from_bytes(shared.value)
        scorer = Scorer(model)
        for batch in batches:
            for low in range(0, len(batch), 200):
                part = batch.slice(low, 200)
                texts = part.column("text").to_pylist()
                scores = model.score(scorer.raw(texts) if model.constant is None else np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(scores, pa.float64())], names=["doc_id", "lang", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(score, "doc_id long, lang string, score double")
    known = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair]) if model.thresholds else None
    threshold = F.coalesce(F.try_element_at(known, F.coalesce("lang", F.lit(""))), F.lit(CUT)) if known is not None else F.lit(CUT)
    out = scored.withColumns({"predicted": (F.col("score") >= CUT).cast("int"), "threshold": threshold})
    return out.withColumn("flagged", F.col("score") >= F.col("threshold"))


def held_out() -> Column:
    """Whether a document's label is kept from training. A null doc_id has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return classify(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "threshold", "flagged")
