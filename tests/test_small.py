"""Small functions that no query reaches: names, labels, histories, truncation, corrected transcripts, shared tables."""

import json

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import batching
from parley.schemas import LABELS, RAW_TAGS
from parley.sources import annotations, release, shared


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_local_names(spark):
    assert values(spark, T.local_name, ["{http://a/b}w", "w", "{}x", "", None]) == ["w", "w", "x", "", None]


def test_raw_labels(spark):
    tags = [*RAW_TAGS, "b", "zz", ""]
    assert values(spark, T.raw_label, tags) == [*RAW_TAGS.values(), "other", "other", "other"]


def test_label_index(spark):
    assert values(spark, T.label_index, [*LABELS, "zz", None]) == [*range(7), -1, None]


def test_history_is_appended(tmp_path):
    path = str(tmp_path / "history.jsonl")
    for event in ({"step": 1, "loss": 0.5}, {"step": 2, "note": "é"}):
        release.append_history(path, event)
    assert [json.loads(x) for x in open(path, encoding="utf-8")] == [{"step": 1, "loss": 0.5}, {"step": 2, "note": "é"}]
    with pytest.raises(ValueError):
        release.append_history(path, {"loss": float("nan")})
    assert len(open(path, encoding="utf-8").readlines()) == 2


def test_truncation_is_counted(spark):
    df = spark.createDataFrame([(0, i, "w " * n) for i, n in enumerate([1, 3, 5, 9])], "batch int, place int, rendered string")
    got = batching.collate(df, lambda texts: [[1] * len(t.split()) for t in texts], max_tokens=4, label=None)
    assert batching.truncation_counts(got).first().asDict() == {"windows": 4, "truncated": 2}
    assert {len(r["input_ids"]) for r in got.collect()} == {4}


def test_transcripts_and_corrections(spark, tmp_path):
    """Only fields with a pipe are renderings; the last line of a key counts; corrections replace, and add keys."""
    (tmp_path / "a.trans").write_text("k1,one | two\nk2,plain\nk1,uno | dos,un | deux\n\nk3,x | y\n")
    (tmp_path / "notes.txt").write_text("k9,a | b\n")
    got = lambda fixes: {r["key"]: r["renderings"] for r in annotations.read_transcripts(spark, str(tmp_path), fixes).collect()}
    assert got(None) == {"k1": ["uno | dos", "un | deux"], "k2": [], "k3": ["x | y"]}
    fixes = spark.createDataFrame([("k3", ["z | y"]), ("k4", ["new | key"])], "key string, renderings array<string>")
    assert got(fixes) == {"k1": ["uno | dos", "un | deux"], "k2": [], "k3": ["z | y"], "k4": ["new | key"]}


def test_tables_in_the_shared_folder(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    for by in ((), ("k",)):
        assert sorted(map(tuple, shared.written(df, "t", *by).select("k", "s").collect())) == [(1, "a"), (2, "b")]
    assert shared.fresh_folder(spark, "t") != shared.fresh_folder(spark, "t") and shared.fresh_folder(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))
