"""Evaluation beyond one table of counts: precision-recall areas, intervals over meetings, ranked links, and baselines that need no training."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS
from ..sources.shared import written

NONE = ""  # what a ranking says for: nobody replies


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """df with sum_x for each x of sums: the sum over a group's rows up to and with each row, in an order without ties.

    Rows are dealt out by ranges and sums of earlier ranges are added, so that a group may be larger than a task. The ranges are written
    once: two uses of them must not draw their bounds anew.
    """
    part = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    totals = part.groupBy(*by, "_part").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_o_{x}") for x in sums])
    here = part.withColumns({f"sum_{x}": F.sum(x).over(inside) for x in sums})
    return here.join(offsets, [*by, "_part"]).withColumns({f"sum_{x}": F.col(f"sum_{x}") + F.col(f"_o_{x}") for x in sums}).select(*df.columns, *[f"sum_{x}" for x in sums])


def pr_auc(gold: DataFrame, predictions: DataFrame, key: str = "seg_id") -> DataFrame:
    """label, positives and pr_auc of each scored label: the mean precision at each threshold, weighed by the recall that it adds. Ties share a threshold.

    predictions has scores, a map of labels to numbers; ids that only one side has are left out (check_coverage tells). A label without gold rows has null.
    """
    both = gold.select(key, F.col("label").alias("gold")).join(predictions.select(key, F.explode("scores").alias("label", "score")), key)
    steps = both.groupBy("label", "score").agg(F.count_if(F.col("label") == F.col("gold")).alias("hits"), F.count(F.lit(1)).alias("n"))
    summed = running_sums(steps, ["label"], [F.col("score").desc()], ["hits", "n"])
    area = F.sum(F.col("hits") * F.col("sum_hits") / F.col("sum_n"))
    return summed.groupBy("label").agg(F.sum("hits").alias("positives"), area.alias("_a")).select("label", "positives", F.when(F.col("positives") > 0, F.col("_a") / F.col("positives")).alias("pr_auc"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from the parts alone, on any engine that has SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("double") / 2.0**32


#: The chances that a Poisson number of mean 1 is at most 0, 1, 2 and so on.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one; 8 for all beyond the table."""
    out = F.lit(len(POISSON))
    for n, below in reversed(list(enumerate(POISSON))):
        out = F.when(u < below, n).otherwise(out)
    return out


def replicate_counts(counts: DataFrame, replicates: int, seed: int = 0, by: str = "meeting") -> DataFrame:
    """replicate, gold, pred and n, where each replicate takes each meeting a Poisson number of times, drawn from its name and the replicate's number."""
    drawn = counts.select(by).distinct().select(by, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    drawn = drawn.withColumn("times", poisson(uniform(F.lit(seed), F.col(by), F.col("replicate")))).filter("times > 0")
    return counts.join(drawn, by).groupBy("replicate", "gold", "pred").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


def f1_by(counts: DataFrame, by: str, labels: Sequence[str] = LABELS) -> DataFrame:
    """by, label and f1, 0 where there is nothing to count; by and the macro mean as label macro."""
    sides = F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    seen = counts.select(by, "n", (F.col("gold") == F.col("pred")).alias("hit"), F.inline(sides))
    total = lambda c: F.sum(F.col("n") * F.col(c))
    f1 = 2 * F.sum(F.when(F.col("hit") & (F.col("g") == 1), F.col("n")).otherwise(0)) / F.nullif(total("g") + total("p"), F.lit(0))
    found = seen.groupBy(by, "label").agg(F.coalesce(f1, F.lit(0.0)).alias("f1"))
    macro = found.groupBy(by).agg((F.sum(F.when(F.col("label").isin(*labels), F.col("f1")).otherwise(0.0)) / len(labels)).alias("f1"))
    return found.unionByName(macro.select(by, F.lit("macro").alias("label"), "f1"))


def bootstrap(counts: DataFrame, replicates: int = 200, seed: int = 0, by: str = "meeting", labels: Sequence[str] = LABELS, level: float = 0.95) -> DataFrame:
    """label (and macro), f1, mean, std, low and high: intervals of F1 from replicates that draw whole meetings. counts: by, gold, pred, n.

    Meetings are counted before they are drawn, so that the draws move counts, at most labels squared for each meeting, and never rows. A
    replicate without a label has an f1 of 0 there.
    """
    own = f1_by(counts.groupBy("gold", "pred").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1)), "all", labels).select("label", "f1")
    drawn = f1_by(replicate_counts(counts, replicates, seed, by), "replicate", labels).select("replicate", "label", F.col("f1").alias("x"))
    grid = own.select("label").join(F.broadcast(counts.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))), how="cross")  # labels by replicates
    filled = grid.join(drawn, ["replicate", "label"], "left").fillna(0.0, ["x"])
    edge = lambda p: F.percentile("x", F.lit(p))
    spread = filled.groupBy("label").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), edge((1 - level) / 2).alias("low"), edge((1 + level) / 2).alias("high"))
    return own.join(spread, "label")


def link_metrics(gold: DataFrame, ranked: DataFrame, ks: Sequence[int] = (1, 3, 5), key: str = "proposal_id") -> DataFrame:
    """kind (reply, none and all), n, mrr and hit_k for each k. gold: key and acceptable, an array that is empty where nobody replies.

    ranked: key and candidates, best first, of which NONE says that nobody replies. A proposal without a ranking, or none of whose candidates is
    acceptable, counts 0; candidates that occur twice keep their first rank.
    """
    wanted = F.when(F.size("acceptable") > 0, F.col("acceptable")).otherwise(F.array(F.lit(NONE)))
    both = gold.select(key, "acceptable").join(ranked.select(key, "candidates"), key, "left").select("acceptable", wanted.alias("wanted"), F.array_distinct("candidates").alias("candidates"))
    places = F.array_min(F.filter(F.transform("candidates", lambda c, i: F.when(F.array_contains("wanted", c), i + 1)), lambda i: i.isNotNull()))
    placed = both.select(F.when(F.size("acceptable") > 0, "reply").otherwise("none").alias("kind"), places.alias("place"))
    placed = placed.select(F.explode(F.array("kind", F.lit("all"))).alias("kind"), "place")
    share = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return placed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), share(1 / F.col("place")).alias("mrr"), *[share((F.col("place") <= k).cast("double")).alias(f"hit_{k}") for k in ks])


def next_speaker(rows: DataFrame, by: str = "meeting", order: str = "position", speaker: str = "speaker_id", key: str = "seg_id") -> DataFrame:
    """rows with next_id: the first later row of another speaker in the same meeting, null where there is none.

    A meeting is runs of one speaker; the row sought begins the next run, so that it is the first later row that begins one. Null is a speaker of its own.
    """
    w = Window.partitionBy(by).orderBy(order)
    begins = ~F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) & F.lag(order).over(w).isNotNull()
    df = rows.withColumn("_begin", F.when(begins, F.col(key)))
    return df.withColumn("next_id", F.first("_begin", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).drop("_begin")


def keyword_labels(rows: DataFrame, rules: Sequence[tuple[str, str]], key: str = "seg_id", text: str = "text", default: str = "other") -> DataFrame:
    """key, label, keyword and place of the longest keyword in each text: default and nulls where there is none. rules: keyword and label.

    Texts and keywords are compared as words, letters and digits in lower case, and keywords match whole words. Of keywords of equal length in letters the one
    that begins first counts. One automaton finds all keywords in one pass over a text; place counts words from 0.
    """
    from .training import words

    clean = lambda s: " ".join(w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split())
    known: dict[str, tuple[str, str]] = {}
    for keyword, label in rules:
        if not clean(keyword):
            raise ValueError(f"a keyword without a letter: {keyword!r}")
        if known.setdefault(clean(keyword), (keyword, label))[1] != label:
            raise ValueError(f"two labels for {keyword!r}")
    kind = dict(rows.dtypes)[key]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, (keyword, label) in known.items():
            automaton.add_word(f" {k} ", (len(k), keyword, label))
        automaton.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for said in batch.column("_said").to_pylist():
                best = max(((n, -(end - n - 1), keyword, label) for end, (n, keyword, label) in automaton.iter(said)), default=None) if known else None
                out.append((best[3], best[2], said.count(" ", 0, -best[1] + 1) - 1) if best else (default, None, None))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=[key, "label", "keyword", "place"])

    said = F.concat(F.lit(" "), F.array_join(words(F.col(text)), " "), F.lit(" ")).alias("_said")
    return rows.select(key, said).mapInArrow(find, f"`{key}` {kind}, label string, keyword string, place int")


def cross_validate(rows: DataFrame, k: int, run: Callable[[DataFrame, DataFrame], Mapping[str, float]], fold: str = "fold") -> DataFrame:
    """fold and the numbers that run(rows of the other folds, rows of this fold) returns, for each of k folds, one after another.

    Rows without a fold, as those of the test split, are never used. Summarise a number with metrics.seed_statistics.
    """
    if k < 2:
        raise ValueError("cross validation takes two folds at least")
    found = [{"fold": i, **run(rows.filter((F.col(fold) >= 0) & (F.col(fold) < k) & (F.col(fold) != i)), rows.filter(F.col(fold) == i))} for i in range(k)]
    if any(a.keys() != b.keys() for a, b in pairwise(found)):
        raise ValueError("folds gave different numbers")
    return rows.sparkSession.createDataFrame([tuple(x.values()) for x in found], ["fold", *list(found[0])[1:]])
