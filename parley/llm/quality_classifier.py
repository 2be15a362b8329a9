"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings become grades: 0 for toxic, 1 for clean but of low quality, 2 for clean and good. One weight vector over hashed text
features is shared by all grades; ordered thresholds t0 < t1 cut the score s: P(grade <= k) = logistic(t_k - s). Expected grade and the
tail probability P(grade = 2) select documents.

Features of a text are those of its words: the word, its first four and five characters and its last two, hashed to
2^BITS weights. The score is SCALE times their mean over all words: what matters is the share of telling words, in texts of
any length. As it is a mean over words, scoring a document is one lookup for each distinct word.

Fitting reads at most SAMPLE_PER_GRADE rated documents a grade, those of the least hashed doc_id (the documented bound), in one
task; rows are weighted by how often their grade is rated. The model is 2^BITS floats, whatever the corpus. Scoring
reads every document whole.

Defined results: null and empty texts have score zero; documents without a rating are scored like the others; several ratings of
a document count as their worst; without any rating all scores are zero and thresholds are the prior's; every feature of a rated document
counts, however rare; repeated rows each get their own row; texts of any length are scored whole, by their distinct words; an empty table
gives an empty table; other columns are ignored. Of rows that share a rated doc_id one is fitted on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

BITS, SAMPLE_PER_GRADE = 20, 2500
STEPS, RATE, PENALTY, SMOOTHING = 60, 0.1, 1e-4, 20.0
SCALE = 10.0
LEAST_TAIL = 0.4  # of the probability of grade 2, for a document to be kept
CACHE_WORDS = 400_000


def words_of(text: str) -> Counter[bytes]:
    return Counter(text.lower().encode().split())


def buckets(word: bytes) -> tuple[int, int, int, int]:
    mask, code = (1 << BITS) - 1, zlib.crc32
    bare = word.strip(b".,;:!?")
    return code(bare) & mask, code(bare[:4], 1) & mask, code(bare[:5], 2) & mask, code(word[-2:], 3) & mask


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = [sorted(words_of(x.as_py()).items()) for x in batch.column("text")]
        lists = [[b for w, _ in c for b in buckets(w)] for c in counted]
        arrays = [pa.array(lists, pa.list_(pa.int32())), pa.array([[n for _, n in c] for c in counted], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), batch.column("weight"), *arrays], names=["doc_id", "grade", "weight", "features", "counts"])


def slopes(grades: np.ndarray, s: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slopes of each row's log-likelihood by its score, the lower and the upper threshold."""
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    b, a = logistic(theta[0] - s), logistic(theta[1] - s)
    gap, none = np.maximum(a - b, 1e-9), np.zeros_like(a)
    return np.choose(grades, [b - 1, a + b - 1, a]), np.choose(grades, [1 - b, -b * (1 - b) / gap, none]), np.choose(grades, [none, a * (1 - a) / gap, -a])


def fit(features: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The weight vector and both thresholds, by Adam on the weighted likelihood. Deterministic.

    features: four for each distinct word of a document; counts: how often the document has the word.
    """
    w = np.zeros(1 << BITS)
    if not len(grades):
        return w, -1.0, 0.0
    share = (np.cumsum(np.bincount(grades, weights, 3)) + [1, 2, 3]) / (weights.sum() + 3)  # padded, so that a missing grade does no harm
    theta = np.log(share[:2] / (1 - share[:2]))  # what fits best where all scores are zero
    column, row = np.concatenate(features), np.repeat(np.arange(len(grades)), [len(f) for f in features])
    value = np.concatenate([np.repeat(c, 4) * (SCALE / max(1, c.sum())) for c in counts])
    weights = weights / weights.sum()
    # Each feature is scaled by the squared widest log ratio of its smoothed rates in two grades: what occurs in a few documents counts for little.
    rates = [np.log((np.bincount(column[grades[row] == g], minlength=len(w)) + SMOOTHING) / (max(1, (grades == g).sum()) + SMOOTHING)) for g in range(3) if (grades == g).any()]
    spread = (np.maximum.reduce(rates) - np.minimum.reduce(rates)) ** 2
    used = np.unique(column)
    column, spread_used = np.searchsorted(used, column), spread[used]
    value = spread_used[column] * value
    v, moment, power = np.zeros((3, len(used)))
    moment_t, power_t = np.zeros((2, 2))
    for step in range(1, STEPS + 1):
        s = np.bincount(row, v[column] * value, len(grades))
        by_score, by_low, by_high = (x * weights for x in slopes(grades, s, theta))
        up = np.bincount(column, by_score[row] * value, len(used)) - PENALTY * v
        up_t = np.array([by_low.sum(), by_high.sum()])
        moment, power = 0.9 * moment + 0.1 * up, 0.999 * power + 0.001 * up * up
        moment_t, power_t = 0.9 * moment_t + 0.1 * up_t, 0.999 * power_t + 0.001 * up_t * up_t
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        v += RATE * (moment / fix) / (np.sqrt(power / fix2) + 1e-8)
        theta += RATE * (moment_t / fix) / (np.sqrt(power_t / fix2) + 1e-8)
        theta[1] = max(theta[1], theta[0] + 1e-3)
    w[used] = v * spread_used
    return w, float(theta[0]), float(theta[1])


def _fit_group(group: pa.Table) -> pa.Table:
    group = group.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    features, counts = ([x.values.to_numpy().astype(np.int64) for x in group.column(c)] for c in ("features", "counts"))
    w, low, high = fit(list(features), list(counts), group.column("grade").to_numpy().astype(np.int64), group.column("weight").to_numpy())
    return pa.table({"weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "low": [low], "high": [high]})


def rated_sample(docs: DataFrame, labels: DataFrame, per_grade: int = SAMPLE_PER_GRADE) -> DataFrame:
    """doc_id, text, grade and weight of at most so many rated documents of each grade: a row for each doc_id, that of the least text hash."""
    grade = F.when(F.max("toxic") == 1, 0).when(F.min("quality") == 0, 1).otherwise(2)
    rated = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(grade.alias("grade"))
    counts = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}  # three rows
    parts = [rated.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade).withColumn("weight", F.lit(max(1.0, n / per_grade))) for g, n in sorted(counts.items())]
    if not parts:
        parts = [rated.withColumn("weight", F.lit(1.0)).limit(0)]
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    # at most three times per_grade rows of three numbers
    own = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = own.groupBy("doc_id", "grade", "weight").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    return one.select("doc_id", "row.text", "grade", "weight")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float]:
    sample = rated_sample(docs, labels).mapInArrow(_featurise, "doc_id long, grade int, weight double, features array<int>, counts array<int>")
    found = sample.groupBy().applyInArrow(_fit_group, "weights binary, low double, high double").collect()
    if not found:
        return fit([], [], np.zeros(0, int), np.zeros(0))
    return np.frombuffer(found[0]["weights"], np.float32), found[0]["low"], found[0]["high"]


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.cache = weights.tolist(), {}

    def score(self, text: str) -> float:
        words = words_of(text)
        if not words:
            return 0.0
        cache = self.cache
        missing = [w for w in words if w not in cache]
        if missing:
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = list(words)
            w = self.weights
            for word in missing:
                a, b, c, d = buckets(word)
                cache[word] = w[a] + w[b] + w[c] + w[d]
        return SCALE * sum([n * cache[w] for w, n in words.items()]) / words.total()


def classify(docs: DataFrame, model: tuple[np.ndarray, float, float], least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, score, expected_grade (0 to 2), tail_probability and kept for each row of docs."""
    weights, low, high = model
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(score, "doc_id long, score double")
    above = lambda t: 1 / (1 + F.exp(F.lit(t) - F.col("score")))
    out = scored.select("*", (above(low) + above(high)).alias("expected_grade"), above(high).alias("tail_probability"))
    return out.withColumn("kept", F.col("tail_probability") >= least_tail)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
