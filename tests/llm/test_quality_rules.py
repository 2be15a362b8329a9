"""op9: statistics, base rules and robust estimates against plain Python and numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from parley.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, own string, content string, g string"


def make(spark, rows):
    """rows of (doc_id, text, lang, source); further columns have names that the operator uses inside."""
    return spark.createDataFrame([(*r, *["en", "s"][len(r) - 2 :], "a", "b", "c", "d") for r in rows], SCHEMA)


def test_quality_statistics(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "été 漢字 it's 42"), (4, "été 漢字 it's 42"), (None, "alone"), (5, "x y " * 30_000), (500, "a b c a b c x a b c"), (501, "a a a a a"), (502, "l1\nl1\n\n \nl1 \n#$%"), (503, "w " * 40_000)]
    got = Counter(tuple(r) for r in Q.text_statistics(make(spark, rows), "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if windows[w[i], w[i + 1], w[i + 2]] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    assert got == Counter((i, *brute(t or "")) for i, t in rows)


def test_quality_rules_reject_outliers_only(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    clean = [(i, ". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(rng.randint(6, 40)))) for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(words) + "%%%" for _ in range(100))) for i in range(20)]
    got = {r["doc_id"]: r for r in Q.quality_rules(make(spark, [*clean, *junk, (2000, None)])).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in junk)
    assert got[2000]["base_failed"] and not got[2000]["kept"]


def test_quality_rules_pool_small_groups(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    clean = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() for _ in range(rng.randint(6, 40)))
    junk = lambda: " ".join(rng.choice(words) + "%%%" for _ in range(100))
    rows = [(i, clean(), "en", "a") for i in range(300)]
    rows += [(1000 + i, junk(), "en", "b") for i in range(5)] + [(2000, clean(), "en", "b"), (1100, junk(), "xx", "c"), (2100, clean(), "xx", "c")]
    got = {r["doc_id"]: r["kept"] for r in Q.quality_rules(make(spark, rows)).collect()}
    assert not any(got[i] for i in (*range(1000, 1005), 1100)) and all(got[i] for i in (*range(300), 2000, 2100))


def estimate(x):
    """The reweighted estimate of some rows, by the module's docstring."""
    floors, h = np.diag(np.square(Q.FLOORS)), np.ceil(Q.SUPPORT * len(x))

    def distance(mean, a):
        y = x - mean
        return y, np.einsum("ij,jk,ik->i", y, np.linalg.inv(a), y)

    def step(mean, a):
        y, d2 = distance(mean, a)
        bins = np.floor(np.log2(d2 + 1e-6) * Q.BINS)
        share, left = np.zeros(len(x)), h
        for b in np.unique(bins):
            inside = bins == b
            share[inside] = min(1.0, max(0.0, left / inside.sum()))
            left -= inside.sum()
        shift = share @ y / h
        return mean + shift, (y * share[:, None]).T @ y / h - np.outer(shift, shift) + floors

    low, middle, high = (np.array([np.sort(np.floor(c * 256))[max(0, int(np.ceil(q * len(x))) - 1)] for c in x.T]) for q in (0.25, 0.5, 0.75))
    centre, scale = (middle + 0.5) / 256, np.sqrt(((high - low) / 256 / 1.349) ** 2 + np.square(Q.FLOORS))
    z = (x - centre) / scale
    u, ridge = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None], 0.05 * np.eye(Q.P)
    trials = []
    for shape in (np.eye(Q.P), np.cov(np.tanh(z).T, bias=True) + ridge if len(x) > 1 else ridge, u.T @ u / len(x) + ridge):
        best = step(centre, shape * np.outer(scale, scale))
        new = step(*best)
        trials.append(new if np.linalg.slogdet(new[1])[1] <= np.linalg.slogdet(best[1])[1] else best)
    now = min(trials, key=lambda e: np.linalg.slogdet(e[1])[1])
    while True:
        new = step(*now)
        gain = np.linalg.slogdet(now[1])[1] - np.linalg.slogdet(new[1])[1]
        now = new if gain >= 0 else now
        if gain < Q.SETTLED:
            break
    y, d2 = distance(now[0], (now[1] - floors) * Q.CONSISTENCY + floors)
    y = y[d2 <= Q.REWEIGHT]
    if not len(y):
        return now[0], (now[1] - floors) * Q.CONSISTENCY + floors, len(x)
    return now[0] + y.mean(0), (y.T @ y / len(y) - np.outer(y.mean(0), y.mean(0))) * Q.REWEIGHTED + floors, len(x)


def drawn(own, wider):
    weight = own[2] / (own[2] + Q.PRIOR_ROWS)
    return own[0] * weight + wider[0] * (1 - weight), own[1] * weight + wider[1] * (1 - weight), own[2]


def test_estimates_and_verdicts(spark):
    """Groups of 240, 40, 3 and 1 rows in two languages, and of null names, with outliers in some."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]

    def text(odd):
        out = [" ".join(rng.choice(words) + odd * (rng.random() < 0.5) for _ in range(rng.randint(6, 14))).capitalize() for _ in range(rng.randint(8, 30))]
        if rng.random() < 0.2:
            out += rng.sample(out, 2)
        return ".\n".join(out)

    rows, groups = [], [("en", "a", 240, 20), ("en", "b", 40, 4), ("en", None, 3, 1), ("fr", "a", 60, 0), ("fr", "c", 1, 1), (None, "a", 5, 0)]
    for lang, source, n, odd in groups:
        rows += [(len(rows) + i, text("%%" if i < odd else ""), lang, source) for i in range(n)]
    rows += [(5000, "too short", "en", "a"), (5001, None, "de", "z")]
    got = {r["doc_id"]: r for r in Q.quality_rules(make(spark, rows)).collect()}
    good = [got[r[0]] for r in rows if not got[r[0]]["base_failed"]]
    vectors = {r["doc_id"]: np.array([r[f] for f in Q.FEATURES]) for r in good}

    def of(test):
        mean, a, n = estimate(np.array([vectors[r["doc_id"]] for r in good if test(r)]))
        return mean, np.linalg.inv(a), n

    everything = of(lambda r: True)
    for lang, source, _, _ in groups:
        language = of(lambda r: r["lang"] == lang)
        mean, precision, _ = drawn(of(lambda r: r["lang"] == lang and r["source"] == source), drawn(language, everything))
        for r in good:
            if r["lang"] == lang and r["source"] == source:
                y = vectors[r["doc_id"]] - mean
                assert r["distance"] == pytest.approx(y @ precision @ y, rel=1e-6)
                assert r["kept"] == (r["distance"] <= Q.CUTOFF)
                if "%" in r_text(rows, r) or not r["n_dup_lines"]:
                    assert r["kept"] == ("%" not in r_text(rows, r))
    assert got[5000]["distance"] is None and not got[5000]["kept"] and got[5001]["base_failed"]


def r_text(rows, r):
    return next(x[1] for x in rows if x[0] == r["doc_id"])


def test_no_determinant_grows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), *map(float, rng.normal(size=5) * (1 + 9 * (i % 5 == 0)))) for g in range(3) for i in range(200)]
    rows = spark.createDataFrame(rows, f"g long, {', '.join(f'{f} double' for f in Q.FEATURES)}")
    now = Q.materialize(Q._inverted(Q._starts(rows, Q._centres(rows))).withColumn("logdet", Q.F.lit(float("inf"))), "test")
    before = {}
    for _ in range(4):
        now = Q.materialize(Q._concentrated(rows, now), "test")
        dets = {(r["g"], r["start"]): r["logdet"] for r in now.collect()}
        assert len(dets) == 9 and all(dets[k] <= before.get(k, np.inf) for k in dets)
        before = dets


def test_query_and_empty_table(spark, tmp_path):
    make(spark, [(1, "a b " * 40), (2, None), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:8] for r in Q.op9_quality_rules(spark, str(tmp_path)).collect()))
    assert got == [(1, 80, 80, 0, 0, 80, True, False), (2, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False)]
    make(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert Q.op9_quality_rules(spark, f"{tmp_path}/none").count() == 0
