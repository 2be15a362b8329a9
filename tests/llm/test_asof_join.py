"""op12: the join against brute force (hot keys, ties, nulls, repeats, clashing names), and the query's rows against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from parley.llm import asof_join as A

SF = "/root/testdata/sf0.001"


def brute(probes, events, tolerance):
    out = []
    for pid, key, at in probes:
        fit = [e for e in events if key is not None and at is not None and e[1] == key and e[2] is not None and at - tolerance <= e[2] <= at]
        low = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  null loses
        best = max(fit, key=lambda e: (e[2], low(e[3]), low(e[0])), default=None)
        n = sum(e[1] == key and e[2] == best[2] for e in events) if best else 0
        out.append((pid, key, at, *((best[0], best[3], best[2]) if best else (None, None, None)), n))
    return sorted(out, key=repr)


def run(spark, probes, events, tolerance):
    p = spark.createDataFrame(probes, "id long, k long, at long")
    e = spark.createDataFrame(events, "id long, k long, at long, rank long")
    got = A.asof_join(p, e, "k", "at", tolerance, {"rank": F.col("rank"), "id": F.col("id")}, {"event_id": F.col("id"), "rank": F.col("rank")})
    return sorted((tuple(r) for r in got.select("id", "k", "at", "event_id", "rank", "matched_at", "n_tied").collect()), key=repr)


@pytest.mark.parametrize("seed, tolerance", [(1, 5), (2, 0), (3, 60), (4, 10**6)])
def test_same_as_brute_force(spark, seed, tolerance):
    """Half the rows have one key, times are dense and tie, and some keys, times and ranks are null."""
    rng = random.Random(seed)
    key = lambda: rng.choice([7, 7, 7, rng.randrange(6), None])
    at = lambda: rng.choice([rng.randrange(300), 10 * rng.randrange(30), None])
    probes = [(i, key(), at()) for i in range(500)]
    events = [(i, key(), at(), rng.choice([1, 2, None])) for i in range(300)]
    events += rng.sample(events, 20)
    assert run(spark, probes, events, tolerance) == brute(probes, events, tolerance)


def test_carried_over_many_slices(spark):
    """One early event answers probes that lie hundreds of rows, and several parts, later; beyond the tolerance none."""
    probes = [(i, 1, 100 + i) for i in range(1000)]
    events = [(5, 1, 50, 3), (6, 1, 50, 9), (7, 2, 60, 1)]
    assert run(spark, probes, events, 700) == brute(probes, events, 700)


def test_times_of_one_instant(spark):
    """Hundreds of events and probes of one key and time: every probe has the same match, and all events are counted."""
    probes, events = [(i, 1, 10) for i in range(300)], [(i, 1, 10, i % 7) for i in range(400)]
    got = run(spark, probes, events, 0)
    assert {r[3:] for r in got} == {(398, 6, 10, 400)} and len(got) == 300


@pytest.mark.parametrize("probes, events", [([], [(1, 1, 1, 1)]), ([(1, 1, 1)], []), ([], [])])
def test_empty_sides(spark, probes, events):
    assert run(spark, probes, events, 5) == [(*p, None, None, None, 0) for p in probes]


def test_repeated_probes_and_columns_that_clash(spark):
    """A probe's own columns come back even if they are called as those of the join."""
    p = spark.createDataFrame([(1, 1, 5, "x", 2), (1, 1, 5, "x", 2)], "id long, k long, at long, found string, slice int")
    e = spark.createDataFrame([(9, 1, 4, "y")], "id long, k long, at long, probe string")
    got = A.asof_join(p, e, "k", "at", 5, {}, {"got": F.col("probe")})
    assert [(r["found"], r["slice"], r["got"], r["n_tied"]) for r in got.collect()] == [("x", 2, "y", 1)] * 2


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([(1, "2024-03-31 02:30:00.000001")], "id long, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert df.select(A.micros("ts")).first()[0] == 1711852200000001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_query_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("clicks", "sales"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted, got = con.sql(A.OP12_SQL), A.op12_asof_join(spark, SF)
    assert got.columns == wanted.columns and {t for _, t in got.dtypes} == {"bigint"}
    rows = lambda x: sorted(map(tuple, x), key=repr)
    assert rows(got.collect()) == rows(wanted.fetchall())
