"""Evaluation against plain Python: areas with ties, intervals over meetings, ranked links, keyword rules, next speakers, folds."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.operators import evaluation as E
from parley.schemas import LABELS


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in rng.sample(range(1000), 500)]
    df = spark.createDataFrame(rows, "g string, i int, v long").repartition(13)
    wanted = [(g, i, v, sum(x[2] for x in rows if x[0] == g and x[1] >= i)) for g, i, v in rows]
    assert sorted(map(tuple, E.running_sums(df, ["g"], [F.col("i").desc()], ["v"]).collect())) == sorted(wanted)


def average_precision(scored):
    """scored: (score, hit); thresholds are the distinct scores."""
    total = sum(h for _, h in scored)
    out, before = 0.0, 0
    for t in sorted({s for s, _ in scored}, reverse=True):
        taken = [h for s, h in scored if s >= t]
        out += (sum(taken) - before) / total * sum(taken) / len(taken)
        before = sum(taken)
    return out


@pytest.mark.parametrize("levels", [3, 50])
def test_pr_auc_with_ties(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(LABELS[:4]), {x: rng.randrange(levels) / levels for x in LABELS[:5]}) for i in range(200)]
    gold, predictions = spark.createDataFrame([r[:2] for r in rows], "seg_id int, label string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "seg_id int, scores map<string, double>")
    got = {r["label"]: r for r in E.pr_auc(gold, predictions).collect()}
    for x in LABELS[:4]:
        assert got[x]["pr_auc"] == pytest.approx(average_precision([(s[x], int(g == x)) for _, g, s in rows])) and got[x]["positives"] == sum(g == x for _, g, _ in rows)
    assert got[LABELS[4]]["pr_auc"] is None and len(got) == 5
    assert E.pr_auc(gold.limit(0), predictions).count() == 0


def test_poisson_numbers_have_mean_and_variance_one(spark):
    got = spark.range(20_000).select(E.poisson(E.uniform(F.lit(3), F.col("id"))).alias("n")).agg(F.avg("n"), F.variance("n"), F.max("n")).first()
    assert got[0] == pytest.approx(1, abs=0.03) and got[1] == pytest.approx(1, abs=0.06) and 5 <= got[2] <= 8


def times(meeting, r, seed):
    u = int(hashlib.sha256(f"{seed}:{meeting}:{r}".encode()).hexdigest()[:8], 16) / 2**32
    return next((n for n, p in enumerate(E.POISSON) if u < p), 8)


def f1(counts, label):
    tp = sum(n for (g, p), n in counts.items() if g == p == label)
    both = sum(n * ((g == label) + (p == label)) for (g, p), n in counts.items())
    return 2 * tp / both if both else 0.0


def test_bootstrap_draws_whole_meetings(spark):
    rng = random.Random(9)
    rows = [(f"m{rng.randrange(6)}", g := rng.choice("xy"), g if rng.random() < 0.7 else rng.choice("xyz"), rng.randrange(1, 5)) for _ in range(30)]
    got = {r["label"]: r for r in E.bootstrap(spark.createDataFrame(rows, "meeting string, gold string, pred string, n long"), 40, 5, labels=("x", "y", "w")).collect()}
    draws = defaultdict(list)
    for r in range(41):  # 0: as it is
        counts = defaultdict(int)
        for m, g, p, n in rows:
            counts[g, p] += n * (times(m, r, 5) if r else 1)
        for label in "xyz":
            draws[label].append(f1(counts, label))
        draws["macro"].append((f1(counts, "x") + f1(counts, "y")) / 3)
    assert set(got) == {"x", "y", "z", "macro"}
    for label, values in draws.items():
        x = sorted(values[1:])
        assert got[label]["f1"] == pytest.approx(values[0]) and got[label]["mean"] == pytest.approx(sum(x) / 40)
        assert x[0] <= got[label]["low"] <= got[label]["mean"] <= got[label]["high"] <= x[-1] and got[label]["low"] == pytest.approx(x[0] + (x[1] - x[0]) * 0.975)


def test_link_metrics_by_hand(spark):
    gold = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, []), (4, []), (5, ["d"]), (6, ["e"])], "proposal_id int, acceptable array<string>")
    ranked = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["x", "x", "c"]), (3, ["", "a"]), (4, ["a"]), (5, []), (9, ["z"])], "proposal_id int, candidates array<string>")
    got = {r["kind"]: tuple(r)[1:] for r in E.link_metrics(gold, ranked, (1, 2)).collect()}
    assert got["reply"] == pytest.approx((4, 0.25, 0, 0.5)) and got["none"] == pytest.approx((2, 0.5, 0.5, 0.5)) and got["all"] == pytest.approx((6, 1 / 3, 1 / 6, 0.5))


def test_next_speaker(spark):
    rows = [("m", 1, "a"), ("m", 2, "a"), ("m", 4, "b"), ("m", 5, None), ("m", 6, None), ("m", 7, "a"), ("n", 1, "a"), ("n", 2, "a")]
    df = spark.createDataFrame([(f"{m}{p}", m, p, s) for m, p, s in rows], "seg_id string, meeting string, position int, speaker_id string")
    assert {r["seg_id"]: r["next_id"] for r in E.next_speaker(df).collect()} == {"m1": "m4", "m2": "m4", "m4": "m5", "m5": "m7", "m6": "m7", "m7": None, "n1": None, "n2": None}


def naive(text, rules, default="other"):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    best = (default, None, None, (0, 0))
    for keyword, label in rules:
        k = re.findall(r"[^\W_]+", keyword.lower())
        for i in range(len(words) - len(k) + 1):
            rank = (len(" ".join(k)), -i)
            if words[i : i + len(k)] == k and rank > best[3]:
                best = (label, keyword, i, rank)
                break
    return best[:3]


def test_keywords_as_by_naive_search(spark):
    rng = random.Random(2)
    parts = ["yes", "no", "Über", "uh", "let's", "go", "1", "x"]
    rules = [("yes", "aa"), ("yes no", "ar"), ("über", "co"), ("no über uh", "cs"), ("Let's go", "cs"), ("go 1 x", "bk"), ("x", "aa"), ("uh uh", "bk")]
    texts = [None, "", "!?", "yesno", *["".join(rng.choice(parts) + rng.choice([" ", ", ", "-", " "]) for _ in range(rng.randrange(12))) for _ in range(200)], "z " * 50_000 + "go 1 X"]
    df = spark.createDataFrame(list(enumerate(texts)), "seg_id int, text string")
    got = {r["seg_id"]: (r["label"], r["keyword"], r["place"]) for r in E.keyword_labels(df, rules).collect()}
    assert got == {i: naive(t, rules) for i, t in enumerate(texts)}
    assert {r["label"] for r in E.keyword_labels(df, [], default="none").collect()} == {"none"} and E.keyword_labels(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("rules", [[("", "aa")], [(" - ", "aa")], [("Yes", "aa"), ("yes!", "ar")]])
def test_keywords_that_are_refused(spark, rules):
    with pytest.raises(ValueError):
        E.keyword_labels(spark.createDataFrame([], "seg_id int, text string"), rules)


def test_folds_are_left_out_in_turn(spark):
    df = spark.createDataFrame([(i, None if i == 9 else i % 3) for i in range(10)], "seg_id int, fold int")
    run = lambda own, aside: {"own": own.count(), "least": aside.agg(F.min("seg_id")).first()[0]}
    assert sorted(map(tuple, E.cross_validate(df, 3, run).collect())) == [(0, 6, 0), (1, 6, 1), (2, 6, 2)]
    with pytest.raises(ValueError):
        E.cross_validate(df, 1, run)
