"""op13: pooling against a plain version, gradients by what they achieve, calibration, odd tables, and labels that were held out."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import toxicity as X
from parley.llm.common import table

SF = "/root/testdata/sf0.1"


def auc(toxic, score):
    order = np.argsort(np.argsort(score, kind="stable"))
    n = toxic.sum()
    return (order[toxic == 1].sum() - n * (n - 1) / 2) / (n * (len(toxic) - n))


def random_model(seed):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(size=shape).astype(np.float32)
    m = X.Model(filters=[draw(w, X.SIZE, X.FILTERS) for w in X.WIDTHS], bias=[draw(X.FILTERS) for _ in X.WIDTHS], weights=draw(len(X.WIDTHS) * X.FILTERS))
    m.table[1:] = draw((1 << X.BITS) - 1, X.SIZE)
    return m


def naive(model, text):
    words = X.words_of(text)
    vectors = [sum(model.table[p] for p in X.parts_of(w)) for w in words] + [np.zeros(X.SIZE)] * X.REACH
    top = [0.0] * len(model.weights)
    for i in range(len(words)):
        for k, w in enumerate(X.WIDTHS):
            z = model.bias[k] + sum(vectors[i + j] @ model.filters[k][j] for j in range(w))
            for f in range(X.FILTERS):
                top[k * X.FILTERS + f] = max(top[k * X.FILTERS + f], z[f])
    return float(np.dot(top, model.weights)) + model.intercept


@pytest.mark.parametrize("chunk", [1, 2, 7, 50_000])
def test_pooling_in_chunks_is_that_of_whole_texts(monkeypatch, chunk):
    monkeypatch.setattr(X, "CHUNK_WORDS", chunk)
    rng, model = random.Random(3), random_model(3)
    texts = ["", "one", " . ", *[" ".join(rng.choice(["der", "die", "Äpfel", "x9", "unlesbarstes", "wort"]) for _ in range(rng.randrange(1, 40))) for _ in range(12)], ""]
    scorer = X.Scorer(model)
    assert scorer.raw(texts) == pytest.approx([naive(model, t) for t in texts], rel=1e-4, abs=1e-4)
    assert scorer.raw(texts[::-1]) == pytest.approx([naive(model, t) for t in texts[::-1]], rel=1e-4, abs=1e-4)  # words are known by now
    assert len(scorer.raw([])) == 0


def made(seed, n=300):
    """Toxic texts hold one of a few words, or two harmless ones side by side; clean ones may hold these apart."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts, toxic = [], []
    for i in range(n):
        said = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = i % 3 == 0
        if bad:
            said.insert(rng.randrange(len(said)), rng.choice(["vilest", "vileness", "go away", "go away"]))
        elif rng.random() < 0.5:
            said.insert(0, "away")
            said.append("go")
        texts.append(" ".join(said))
        toxic.append(int(bad))
    return texts, np.array(toxic)


def test_learns_words_parts_and_pairs():
    """Also in words that it never saw (vilely, by their first letters), and not from either half of a pair."""
    trace = []
    model = X.fit(*made(1, 900), trace=trace)
    texts, toxic = made(2)
    scorer = X.Scorer(model)
    assert trace[-1] < trace[0] / 3 and auc(toxic, scorer.raw(texts)) > 0.97
    bad, good = scorer.raw(["w1 w2 vilely w3", "w5 go away w7"]), scorer.raw(["w1 w2 w4 w3", "away w5 w9 go"])
    assert bad.min() > good.max()


def test_calibration():
    raw = np.array([-3.0, -2, -2, -1, 4, 5, 6, -1.5])
    toxic = np.array([0, 0, 0, 0, 1, 1, 1, 0])
    assert X.best_cut(raw, toxic) == 1.5
    model = X.calibrate(X.Model(), raw, toxic, ["a"] * 6 + ["b"] * 2)
    scores = model.score(raw)
    assert ((scores >= X.CUT) == (toxic == 1)).all() and set(model.thresholds) == {"a", "b"}
    assert X.best_cut(np.array([1.0, 1, 1]), np.array([1, 0, 1])) < 1  # ties stay together


def frames(spark, texts, toxic):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")


def test_one_model_in_spark_as_in_numpy_and_saved(spark):
    texts, toxic = made(4)
    docs, labels = frames(spark, texts, toxic)
    model = X.train(docs, labels)
    own = X.train_model(list(range(len(texts))), texts, toxic, ["en"] * len(texts))
    assert np.array_equal(model.table, own.table) and model.shift == own.shift and model.thresholds == own.thresholds
    got = {r["doc_id"]: r for r in X.classify(docs, model).collect()}
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(own.score(X.Scorer(own).raw(texts)).tolist(), abs=1e-5)
    assert all(r["predicted"] == (r["score"] >= 0.7) and r["flagged"] == (r["score"] >= r["threshold"]) for r in got.values())


def test_only_the_text_is_scored(spark):
    texts, toxic = made(5, 60)
    docs, labels = frames(spark, texts, toxic)
    model = X.train(docs, labels)
    other = docs.select((F.col("doc_id") + 10**9).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit("x").alias("source"), F.lit(1).alias("score"))
    scores = lambda df: [r["score"] for r in X.classify(df, model).orderBy("doc_id").collect()]
    assert scores(docs) == scores(other)


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    """20,000 rows of one doc_id are one row of the fit, equal texts too; of several labels the worst counts, of equal texts the mean."""
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(2, "b", "en"), (3, "b", "en"), (4, "b", None), (5, None, "en"), (6, "f", "en")], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in X.labelled_sample(docs, labels).collect()) == [(1, "a", "en", 1), (2, "b", "en", 0), (5, "", "en", 1)]
    assert X.labelled_sample(docs, labels, per_class=1).count() == 2


@pytest.mark.parametrize("toxic, score", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_without_both_classes(spark, toxic, score):
    docs, labels = frames(spark, ["a b", "", None], toxic)
    got = X.classify(docs, X.train(docs, labels)).collect()
    assert [r["score"] for r in got] == [score] * 3


def test_odd_tables(spark):
    """No documents, null and very long texts, null ids, repeated rows."""
    texts, toxic = made(6, 40)
    docs, labels = frames(spark, texts, toxic)
    model = X.train(docs, labels)
    assert X.classify(docs.limit(0), model).count() == 0 and X.train(docs.limit(0), labels).constant == 0.0
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "w1 " * 200_000 + "go away")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = X.classify(odd, model).collect()
    assert len(got) == 4 and got[0]["score"] == got[1]["score"] == got[2]["score"] and got[3]["score"] == pytest.approx(float(model.score(X.Scorer(model).raw(["w1 w1 w1 go away"]))[0]), abs=1e-5)


def test_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in X.op13_toxicity(spark, SF).collect()}
    docs = [r["doc_id"] for r in table(spark, SF, "documents").collect()]
    assert sorted(got) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]) for r in table(spark, SF, "labels").collect() if got[r["doc_id"]]["held_out"]]
    toxic, scores = np.array([t for t, _ in held]), np.array([r["score"] for _, r in held])
    predicted = np.array([r["predicted"] for _, r in held])
    assert auc(toxic, scores) > 0.95 and predicted[toxic == 1].mean() > 0.85 and predicted[toxic == 0].mean() < 0.03
