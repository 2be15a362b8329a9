"""op10: slopes against a plain likelihood, the fitted model against what it was given, odd tables."""

import math
import random

import numpy as np
import pytest

from parley.llm import quality_classifier as C


def likelihood(grade, s, low, high):
    p = lambda t: 1 / (1 + math.exp(s - t))
    return math.log((p(low), p(high) - p(low), 1 - p(high))[grade])


@pytest.mark.parametrize("grade", [0, 1, 2])
def test_slopes(grade):
    rng = random.Random(grade)
    for _ in range(50):
        s, low = rng.uniform(-4, 4), rng.uniform(-3, 1)
        high, h = low + rng.uniform(0.1, 3), 1e-6
        got = [float(x[0]) for x in C.slopes(np.array([grade]), np.array([s]), np.array([low, high]))]
        f = lambda a, b, c: likelihood(grade, a, b, c)
        wanted = [(f(s + h, low, high) - f(s - h, low, high)) / (2 * h), (f(s, low + h, high) - f(s, low - h, high)) / (2 * h), (f(s, low, high + h) - f(s, low, high - h)) / (2 * h)]
        assert got == pytest.approx(wanted, rel=1e-4, abs=1e-6)


def test_fitting_raises_the_likelihood():
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 3, 300)
    features = [np.array([*np.repeat(g * 10 + rng.integers(0, 4, 3), 4), *rng.integers(100, 200, 8)]) for g in grades]
    counts = [np.ones(5, int) for _ in grades]
    w, low, high = C.fit(features, counts, grades, np.ones(300))
    scores = [C.SCALE / 5 * w[f].sum() for f in features]
    base = np.log(np.bincount(grades) / 300)[grades].mean()
    assert low < high and np.mean([likelihood(g, s, low, high) for g, s in zip(grades, scores)]) > base / 2


@pytest.mark.parametrize("grades", [[0], [2, 2], [0, 1, 2], []])
def test_few_ratings(grades):
    """Each rating counts, however few there are; without any, scores are zero."""
    features = [np.array([7 * g + 1] * 4) for g in grades]
    w, low, high = C.fit(features, [np.array([1])] * len(grades), np.array(grades, int), np.ones(len(grades)))
    assert np.isfinite(w).all() and low < high and (len(grades) == 3) == bool(np.any(w))
    if len(grades) == 3:
        assert w[1] < w[8] < w[15] or w[1] < w[15]


def test_query_and_odd_tables(spark, tmp_path):
    rows = [(1, "good words here", 0.0), (1, "good words here", 0.0), (2, None, 0.0), (3, "", 0.0), (None, "bad words", 0.0), (4, "bad words " * 200_000, 0.0)]
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 0), (99, 0, 0)]
    for name, some in (("all", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, score double").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = C.op10_quality_classifier(spark, f"{tmp_path}/all").collect()
    assert len(out) == len(rows) and len({tuple(r) for r in out if r["doc_id"] == 1}) == 1
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (2, 3)) and all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)
    assert C.op10_quality_classifier(spark, f"{tmp_path}/none").count() == 0


def test_repeated_rows_are_fitted_on_once(spark):
    """20,000 rows of one rated doc_id are one row of the fitting task; of texts that differ, that of the least hash."""
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a"), (F.col("id") % 3).cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"t{i}") for i in range(2, 7)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, int(i == 3)) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    got = C.rated_sample(docs, labels, per_grade=2).collect()
    assert len(got) <= 6 and len({r["doc_id"] for r in got}) == len(got)
    one = C.rated_sample(docs, labels.filter("doc_id = 1")).collect()
    assert [r["text"] for r in one] == [docs.filter("doc_id = 1").orderBy(F.xxhash64("text")).first()["text"]]
