"""What shows only on large tables: names of six letters, chunks larger than a task, long chains, plans without needless shuffles."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import annotate, batching, parse, training
from parley.plans.queries import QUERIES, SQL


def name(index):
    out, left = "", index + 1
    while left:
        left, letter = divmod(left - 1, 26)
        out = chr(65 + letter) + out
    return out


def test_names_of_six_letters(spark, tmp_path):
    """The function gives whole names; window_letters gives of them what its SQL does."""
    ids = [0, 3, 1765231, 1765232, 1765233, 5_999_999, 45_000_000]
    df = spark.createDataFrame([(i,) for i in ids], "event_id long")
    df.write.parquet(f"{tmp_path}/events.parquet")
    whole = {r["event_id"]: r["x"] for r in df.select("event_id", T.window_letter(df["event_id"] * 7).alias("x")).collect()}
    assert whole == {i: name(i * 7) for i in ids} and len(whole[1765232]) == 5 and len(whole[1765233]) == 6
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["window_letters"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(SQL["window_letters"]).fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_may_be_larger_than_a_task(spark):
    """Places in a chunk come from ranges of rows: no window over a whole chunk, and the batches of a plain Python version."""
    sha = lambda start, *by: hashlib.sha256(":".join(map(str, (start, *by))).encode()).hexdigest()
    data = [(i, (i * 37) % 11) for i in range(203)]
    got = batching.train_batches(spark.createDataFrame(data, "id long, chars int"), 8, 6, "id", seed=5)
    assert not re.search(r"windowspecdefinition\(_chunk", plan_of(got))
    drawn = sorted((sha(5, i), i, n) for i, n in data)
    places = {}
    for chunk in range(0, len(drawn), 48):
        for k, (_, i, _) in enumerate(sorted(drawn[chunk : chunk + 48], key=lambda x: (x[2], x[0], x[1]))):
            places[i] = (chunk // 48, k // 8, k % 8)
    order = {b: n for n, b in enumerate(sorted({p[:2] for p in places.values()}, key=lambda b: (sha(6, *b), b)))}
    assert {r["id"]: (r["batch"], r["place"]) for r in got.collect()} == {i: (order[p[:2]], p[2]) for i, p in places.items()}


def test_terms_are_counted_where_rows_are_read(spark):
    """No shuffle of terms where keys are unique; rows of one key, null too, are one text."""
    rows = [(1, "Ab ab c"), (2, ""), (3, "c"), (3, "c d"), (None, "x"), (None, "x y")]
    df = spark.createDataFrame(rows, "k int, text string")
    alone = training.term_counts(df.filter("k < 3"), "k")
    assert "Exchange" not in plan_of(training.weighted(alone, training.vocabulary(alone, 2, 5), "k"))
    counts = training.term_counts(df, "k")
    got = {r["k"]: dict(zip(r["terms"], r["tfs"])) for r in counts.collect() if r["terms"]}
    assert got == {1: {"ab": 2, "c": 1}, 3: {"c": 2, "d": 1}, None: {"x": 2, "y": 1}}
    assert {r["term"]: r["df"] for r in training.vocabulary(counts, 6, 5).collect()} == {"ab": 1, "c": 2, "d": 1, "x": 1, "y": 1}


def test_few_steps_are_many_files(spark):
    """Rows of a step are dealt out by size, not by the number of its batches."""
    df = spark.range(40_000).selectExpr("id", "id % 2 AS step", "sha2(cast(id AS string), 256) AS x")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        steps = training.written_steps(df.repartition(8))
        assert len(steps.inputFiles()) > 6 and steps.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_links_are_pruned_whole(spark):
    """Chains are not taken apart and put together again: links meet what they lose in one join. Links of one id stay apart; nulls in a chain stay."""
    rows = [("a", [["b", "c", "b"], ["d"]], "ok"), ("a", [["d", "e"]], "ok"), ("f", [["d"], []], "ok"), ("g", [["x", None, "d"]], "ambiguous"), ("h", None, "no_pair"), ("d", [["a"]], "ok")]
    links = spark.createDataFrame([(i, c, bool(c), s) for i, c, s in rows], "proposal_id string, responder_chains array<array<string>>, has_response boolean, status string")
    got = annotate.prune_chains(links, spark.createDataFrame([("d",), ("c",)], "seg_id string"))
    wanted = [("a", [["b", "b"]], True, "ok"), ("a", [["e"]], True, "ok"), ("f", [], False, "no_pair"), ("g", [["x", None]], True, "ambiguous"), ("h", [], False, "no_pair")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_pipes_in_a_long_act(spark):
    """The words' text is read once, not once for each number of words: the text of all prefixes of this act would be 250 MB."""
    said = [f"w{i:05d}" for i in range(9000)]
    df = spark.createDataFrame([(1, said), (2, ["a", None, "-", "b"])], "k int, w array<string>")
    df = df.select("k", F.transform("w", lambda x: F.struct(x.alias("text"), F.lit("w").alias("kind"))).alias("words"))
    given = F.when(F.col("k") == 1, F.lit(" ".join(said[:7000]) + " | " + " ".join(said[7000:]))).otherwise("A. | B")
    plan = df.select("k", parse.pipe_boundaries("words", given, F.lit(2)).alias("b"), parse.pipe_boundaries("words", F.lit("a | x | b"), F.lit(3)).alias("none"))
    assert {r["k"]: (r["b"], r["none"]) for r in plan.collect()} == {1: ([7000], None), 2: ([3], None)}
    assert df.select(parse.lexical_text("words").alias("x")).selectExpr("size(x.ends) AS n", "length(x.whole) AS c").collect()[0] == (9001, 54000)
