"""The pipeline on odd tables: nulls, ties, repeated rows, near copies, a column with an inner name; what it leaves in the shared folder."""

import os
import random
from collections import Counter

import pytest

from parley.llm import common

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _content string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "mine") for i, t, lang in rows], SCHEMA)


def test_keep_rows(spark, monkeypatch):
    rows = [(1, "a", "en"), (1, "a", "fr"), (1, "a", "fr"), (2, "b", "en"), (None, "c", "en"), (None, None, "en"), (3, "d", "en"), (3, "e", "en")]
    docs = make(spark, rows)
    content = {r["text"]: r["c"] for r in docs.selectExpr("text", "xxhash64(text) AS c").collect()}
    marks = spark.createDataFrame([(1, content["a"], True, 3), (2, content["b"], False, 1), (None, content["c"], False, 1), (None, content[None], True, 1), (3, content["e"], False, 1)], "doc_id long, content long, kept boolean, copies long")
    for most in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        got = common.keep_rows(docs, marks)
        assert got.columns == docs.columns and {r["_content"] for r in got.collect()} == {"mine"}
        # of the repeats the one that comes first as JSON stays
        assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == Counter([(1, "a", "en"), (None, None, "en"), (3, "d", "en")])
    by_lang = marks.limit(0).selectExpr("doc_id", "content", "'en' AS lang", "kept", "copies").unionByName(spark.createDataFrame([(1, content["a"], "fr", False, 1)], "doc_id long, content long, lang string, kept boolean, copies long"))
    assert Counter((r["doc_id"], r["lang"]) for r in common.keep_rows(docs, by_lang, "lang").collect())[1, "fr"] == 0


def test_run(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = lambda n=120: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(), "en") for i in range(60)]
    near = rows[5][1].split()
    near[50] = "changed"
    rows += [(100, rows[3][1].replace(" ", "\n"), "en"), (3, rows[3][1], "en"), (3, rows[3][1], "fr"), (101, " ".join(near), "en"), (None, text(), "en"), (None, text(), "en"), (102, None, "en"), (103, "short", None), (104, rows[4][1] + " mail a@b.co", None), (105, text(30_000), "en")]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(common.shared_folder(spark))) if os.path.isdir(common.shared_folder(spark)) else set()
    out = pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids - {105} == {*range(60), None} and sum(r["doc_id"] is None and r["piece"] == 0 for r in out) == 2
    stages = [x for x in set(os.listdir(common.shared_folder(spark))) - before if not x.startswith(("parley-pieces", "parley-packed"))]
    assert len(stages) == 1 and stages[0].startswith("parley-personal-data")
    make(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
