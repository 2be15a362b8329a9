"""Reproducible splits and folds of whole meetings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import SPLITS

COUNTS = {"train": 51, "val": 12, "test": 12}
SEED, FOLDS = "icsi-mrda-split-v1", 5


def assign_folds(meetings: DataFrame, k: int = FOLDS, by: str = "meeting") -> DataFrame:
    """meetings with fold: their rank modulo k. The meetings of a release are few; rows never take part."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 2:
        raise ValueError("k is an integer of at least 2")
    return meetings.select(by).distinct().withColumn("fold", ((F.row_number().over(Window.orderBy(by)) - 1) % k).cast("int"))


def allocate(sizes: Mapping[str, int], counts: Mapping[str, int]) -> dict[str, dict[str, int]]:
    """How many meetings of each series go to each split: whole quotas first, then one at a time where most of a quota is
    unmet; ties go to the first series, then the first split."""
    total = sum(sizes.values())
    if sum(counts.values()) != total or set(counts) != set(SPLITS):
        raise ValueError("split counts must name the three splits and add up to the number of meetings")
    quota = {s: {x: sizes[s] * counts[x] / total for x in SPLITS} for s in sorted(sizes)}
    given = {s: {x: int(q) for x, q in row.items()} for s, row in quota.items()}
    left = {x: counts[x] - sum(row[x] for row in given.values()) for x in SPLITS}
    while any(n > 0 for n in left.values()):
        open_cells = [(s, x) for s in given if sum(given[s].values()) < sizes[s] for x in SPLITS if left[x]]
        if not open_cells:
            raise ValueError("every series is used up before the splits are full")
        s, x = max(open_cells, key=lambda c: quota[c[0]][c[1]] - given[c[0]][c[1]])  # max keeps the first of equals
        given[s][x] += 1
        left[x] -= 1
    return given


def series_order(meetings: DataFrame, seed: str = SEED, by: str = "meeting") -> DataFrame:
    """by, series and rank: the order of a series' meetings by seeded SHA-256, from 0."""
    w = Window.partitionBy("series").orderBy(F.sha2(F.concat(F.lit(seed + ":"), F.col(by)), 256))
    return meetings.select(by).distinct().withColumn("series", T.series(F.col(by))).withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def assign_splits(meetings: DataFrame, counts: Mapping[str, int] = COUNTS, seed: str = SEED, by: str = "meeting") -> DataFrame:
    """by and split. The sizes of the series (letters before a number, hence few) come to the driver."""
    ordered = series_order(meetings, seed, by)
    sizes = {r["series"]: r["count"] for r in ordered.groupBy("series").count().collect()}
    if "" in sizes:
        raise ValueError("a meeting has no series: its id starts with no letter")
    given = allocate(sizes, counts)
    ends = [(s, x, sum(row[y] for y in SPLITS[:i]), sum(row[y] for y in SPLITS[: i + 1])) for s, row in given.items() for i, x in enumerate(SPLITS)]
    cells = meetings.sparkSession.createDataFrame(ends, "series string, split string, low int, high int")
    return ordered.join(F.broadcast(cells), "series").filter("rank >= low AND rank < high").select(by, "split")


def split_problems(universe: DataFrame, lists: DataFrame, by: str = "meeting") -> DataFrame:
    """rule and id wherever lists (by, split) do not deal out the universe (by) exactly: each meeting once, to one of the splits."""
    said = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("id"))
    empty = F.coalesce(F.col(by), F.lit("")) == ""
    listed = lists.groupBy(by).agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n"), F.max((~F.col("split").isin(*SPLITS)).cast("int")).alias("odd"))
    both = universe.select(by).distinct().withColumn("_u", F.lit(1)).join(listed, by, "full_outer")
    out = said(universe.select(by).unionByName(lists.select(by)).filter(empty).distinct(), "a meeting has no id")
    out = out.unionByName(said(universe.groupBy(by).count().filter("count > 1"), "a meeting occurs twice in the universe"))
    out = out.unionByName(said(both.filter("odd = 1"), "an unknown split")).unionByName(said(both.filter("splits > 1"), "a meeting is in several splits"))
    out = out.unionByName(said(both.filter("n > splits"), "a meeting occurs twice in a split")).unionByName(said(both.filter("_u IS NULL"), "a listed meeting is not in the universe"))
    return out.unionByName(said(both.filter("n IS NULL"), "a meeting is in no split"))


def split_provenance(universe: DataFrame, lists: DataFrame, k: int = FOLDS, reasons: DataFrame | None = None, by: str = "meeting") -> DataFrame:
    """by, split, reason and fold (null in test) of valid lists, see split_problems. reasons (by, reason) replace the standard one.

    Folds deal out train and val together, in order of ids.
    """
    from .checks import raise_first

    raise_first(split_problems(universe, lists, by))
    folds = assign_folds(lists.filter("split <> 'test'"), k, by)
    named = lists.join(reasons.select(by, "reason"), by, "left") if reasons is not None else lists.withColumn("reason", F.lit(None).cast("string"))
    return named.join(folds, by, "left").select(by, "split", F.coalesce("reason", F.concat(F.lit("listed in "), F.col("split"))).alias("reason"), "fold")


def attach_splits(rows: DataFrame, assignments: DataFrame, by: str = "meeting") -> DataFrame:
    """rows with split and fold; an error at run time for a meeting without an assignment."""
    if {"split", "fold"} & set(rows.columns):
        raise ValueError("rows already have split or fold")
    known = assignments.select(by, "split", "fold", F.lit(True).alias("_known"))
    joined = rows.join(known, by, "left")
    missing = F.raise_error(F.concat(F.lit("no split for "), F.col(by).cast("string"))).cast("string")
    return joined.withColumn("split", F.when(F.col("_known"), F.col("split")).otherwise(missing)).drop("_known")
