"""Training on Spark against loops over batches in numpy: weights, losses, schedules, the choice of the epoch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import training as M
from parley.schemas import LABELS
from parley.sources.shared import written

CLASSES = ("a", "b", "c")


def rows(spark, n=90, width=12, seed=3):
    """Sparse rows whose class follows from their terms, some without a label, one without terms."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = int(rng.integers(3))
        columns = sorted({int(x) for x in rng.choice(width, rng.integers(1, 5))} | {y}) if i else []
        out.append((i, y if i % 11 else None if i % 2 else -100, columns, [float(x) for x in rng.uniform(0.2, 1, len(columns))], len(columns)))
    df = spark.createDataFrame(out, "seg_id long, y int, columns array<int>, weights array<double>, chars int")
    return df.withColumn("label", F.when(F.col("y") >= 0, F.array(*map(F.lit, CLASSES))[F.col("y")]))


def loop(steps, width, plan):
    """The same by a loop over batches: dense features, softmax, mean of batch means, clipping, AdamW."""
    found = steps.collect()
    w = np.zeros((width + 1, 3))
    m, v, t, losses = np.zeros_like(w), np.zeros_like(w), 0, []
    groups = {}
    for r in found:
        groups.setdefault(r["step"], {}).setdefault(r["batch"], []).append(r)
    total = plan.epochs * len(groups)
    for _ in range(plan.epochs):
        batch_losses = []
        for step in sorted(groups):
            g = np.zeros_like(w)
            for batch in groups[step].values():
                x = np.zeros((len(batch), width + 1))
                for k, r in enumerate(batch):
                    x[k, r["columns"]] = r["weights"]
                    x[k, -1] = 1
                z = x @ w
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                y = np.array([r["y"] for r in batch])
                batch_losses.append(-np.log(p[np.arange(len(y)), y]).mean())
                g += x.T @ (p - np.eye(3)[y]) / len(batch) / len(groups[step])
            norm = np.sqrt((g * g).sum())
            g *= min(1, plan.clip / (norm + 1e-6))
            rise = int(plan.warmup * total)
            left = (t - rise) / max(1, total - rise)
            rate = plan.rate * (t / rise if t < rise else {"linear": 1 - left, "cosine": (1 + math.cos(math.pi * left)) / 2, "constant": 1}[plan.schedule])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w[:-1] *= 1 - rate * plan.decay
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(np.mean(batch_losses))
    return w, losses


@pytest.mark.parametrize("plan", [
    M.Plan(epochs=4, batch_size=8, accumulate=3, rate=0.1, warmup=0.25), M.Plan(epochs=2, batch_size=16, rate=0.2, clip=0.05, schedule="constant", warmup=0),
    M.Plan(epochs=3, batch_size=200, accumulate=5, rate=0.3, decay=0.2, schedule="cosine"),
])
def test_same_weights_as_a_loop(spark, plan):
    df = rows(spark)
    steps = written(M.step_table(df, plan, "seg_id"), "steps", "step")
    found = M.train(steps, df.filter("y >= 0"), 12, CLASSES, plan)
    wanted, losses = loop(steps, 12, plan)
    epochs = [h for h in found["history"] if h["type"] == "epoch"]
    assert np.abs(found["model"] - wanted).max() < 1e-6
    assert [h["train_loss"] for h in epochs] == pytest.approx(losses, abs=1e-9) and losses == sorted(losses, reverse=True)
    assert [h["step"] for h in found["history"] if h["type"] == "step"] == list(range(1, plan.epochs * len(steps.select("step").distinct().collect()) + 1))
    assert found["epoch"] == max(epochs, key=lambda h: (h["macro_f1"], -h["epoch"]))["epoch"] and found["score"] > 0.5


def test_shares_of_a_step(spark):
    """Each step's shares sum to one, each batch weighs the same in its step, and rows without a label have none."""
    plan = M.Plan(batch_size=8, accumulate=3)
    steps = M.step_table(rows(spark), plan, "seg_id")
    by_batch = steps.groupBy("step", "batch").agg(F.sum("share").alias("s"), F.min("y").alias("y"))
    got = {}
    for r in by_batch.collect():
        assert r["y"] >= 0
        got.setdefault(r["step"], []).append(r["s"])
    assert all(sum(s) == pytest.approx(1) and max(s) == pytest.approx(min(s)) for s in got.values()) and sorted(got) == list(range(plan.steps(12)))


def test_learning_rate_rises_and_falls():
    plan = M.Plan(rate=1.0, warmup=0.5)
    assert [plan.learning_rate(i, 8) for i in range(8)] == [0, 0.25, 0.5, 0.75, 1, 0.75, 0.5, 0.25]
    assert M.Plan(rate=2.0, warmup=0, schedule="constant").learning_rate(7, 8) == 2


@pytest.mark.parametrize("wrong", [{"epochs": 0}, {"accumulate": 0}, {"batch_size": 0}, {"warmup": 1.0}, {"warmup": -0.1}, {"schedule": "steps"}])
def test_plans_that_are_refused(wrong):
    with pytest.raises(ValueError):
        M.Plan(**wrong)


def test_ties_keep_the_earlier_epoch(spark):
    df = rows(spark)
    plan = M.Plan(epochs=3, batch_size=100, rate=1e-12)
    logged = []
    found = M.train(written(M.step_table(df, plan, "seg_id"), "steps", "step"), df.filter("y >= 0"), 12, CLASSES, plan, select=("a", "b"), on_log=logged.append)
    assert found["epoch"] == 1 and logged == found["history"] and [h["is_best"] for h in logged if h["type"] == "epoch"] == [True, False, False]


def test_tf_idf_by_hand(spark):
    df = spark.createDataFrame([(1, "Ab ab, c!"), (2, "c d"), (3, ""), (4, None)], "k int, text string")
    counts = M.term_counts(df, "k")
    terms = M.vocabulary(counts, 4, 2)
    assert [(r["term"], r["column"], r["df"]) for r in terms.orderBy("column").collect()] == [("c", 0, 2), ("ab", 1, 1)]
    idf = lambda n: math.log(5 / (1 + n)) + 1
    got = {(r["k"], r["term"]): r["weight"] for r in M.tf_idf(counts, terms, "k").collect()}
    length = math.hypot(2 * idf(1), idf(2))
    assert got == {(1, "ab"): pytest.approx(2 * idf(1) / length), (1, "c"): pytest.approx(idf(2) / length), (2, "c"): pytest.approx(1)}
    arrays = {r["k"]: (r["columns"], len(r["weights"])) for r in M.features(df, counts, terms, "k").collect()}
    assert arrays == {1: ([0, 1], 2), 2: ([0], 1), 3: ([], 0), 4: ([], 0)}


def test_gradient_of_no_rows(spark):
    df = rows(spark).withColumn("share", F.lit(1.0)).limit(0)
    up, loss = M.gradient(df, np.ones((13, 3)))
    assert not up.any() and up.shape == (13, 3) and loss == 0


def test_two_stages(spark):
    """Both models learn, the second from targets only, and each row's seven scores are those of the two stages."""
    rng = np.random.default_rng(6)
    out = []
    for i in range(240):
        y = int(rng.integers(7))
        out.append((i, LABELS[y], sorted({y, int(rng.integers(7, 12))}), len(LABELS)))
    df = spark.createDataFrame(out, "seg_id long, label string, columns array<int>, chars int").withColumn("weights", F.transform("columns", lambda _: F.lit(1.0)))
    found = M.two_stages(df.filter("seg_id >= 60"), df.filter("seg_id < 60"), 12, M.Plan(epochs=6, batch_size=16, rate=0.3))
    rows = found["combined"].collect()
    assert sorted(r["seg_id"] for r in rows) == list(range(60)) and all(sum(r["scores"]) == pytest.approx(1) and len(r["scores"]) == 7 for r in rows)
    assert all(r["label"] == LABELS[int(np.argmax(r["scores"]))] for r in rows) and found["macro_f1"] > 0.9
    assert found["first"]["model"].shape == (13, 2) and found["second"]["model"].shape == (13, 6) and found["second"]["score"] > 0.9


def test_cross_validation_trains_each_fold_as_the_model(spark, monkeypatch):
    """All epochs and steps of the plan, on each two of three folds."""
    from parley.plans import queries

    plans = []
    monkeypatch.setattr(queries.training, "train", lambda steps, aside, size, classes, plan, key: plans.append((plan, steps.select("step").distinct().count())) or {"score": 0.0})
    rows = queries.cross_validated(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(plans) == 3
    for (plan, steps), row in zip(plans, rows):
        assert queries.training.replace(plan, batch_size=1) == queries.training.replace(queries.TRAINING, batch_size=1)
        assert plan.batch_size == -(-row["rows"] // queries.BATCHES) and steps == plan.steps(-(-row["rows"] // plan.batch_size))
