"""Scores of predictions against gold labels, all derived from one count table of at most labels squared rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS, TARGETS


def label_table(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "idx int, label string")


def coverage(gold: DataFrame, predictions: DataFrame, key: str = "seg_id", examples: int = 5) -> DataFrame:
    """side (missing: gold only, extra: predictions only), n and the first ids."""
    both = gold.select(key, F.lit(1).alias("g")).join(predictions.select(key, F.lit(1).alias("p")), key, "full_outer")
    odd = both.filter("g IS NULL OR p IS NULL").select(key, F.when(F.col("p").isNull(), "missing").otherwise("extra").alias("side"))
    counts = odd.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    first = odd.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy(key))).filter(F.col("rn") <= examples)
    return counts.join(first.groupBy("side").agg(F.array_sort(F.collect_list(key)).alias("examples")), "side")


def check_coverage(gold: DataFrame, predictions: DataFrame, key: str = "seg_id") -> None:
    """Raises, with counts and examples, unless both have the same ids. Triggers a job."""
    found = {r["side"]: r for r in coverage(gold, predictions, key).collect()}  # two rows
    if found:
        raise ValueError("; ".join(f"{found[s]['n']} {s}, e.g. {', '.join(map(str, found[s]['examples']))}" for s in sorted(found)))


def pair_counts(gold: DataFrame, predictions: DataFrame, key: str = "seg_id") -> DataFrame:
    """gold, pred, n of all ids in both."""
    joined = gold.select(key, F.col("label").alias("gold")).join(predictions.select(key, F.col("label").alias("pred")), key)
    return joined.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def subset_counts(gold: DataFrame, predictions: DataFrame, key: str = "seg_id") -> DataFrame:
    """gold, pred, n of all gold ids; predictions may have more. A gold id without a prediction is an error at run time."""
    joined = gold.select(key, F.col("label").alias("gold")).join(predictions.select(key, F.col("label").alias("pred")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast("string")
    return joined.select("gold", F.coalesce("pred", missing).alias("pred")).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def mean_loss(history: DataFrame, by: list[str], loss: str = "loss", weight: str | None = None) -> DataFrame:
    """by and mean_loss: over steps, or over windows if weight says how many each step had; null where there are none."""
    total = F.sum(F.col(loss) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)) if weight else F.avg(loss)
    return history.groupBy(*by).agg(total.alias("mean_loss"))


def confusion(counts: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """gold, pred, n for each pair of labels, zeros included."""
    dim = label_table(counts, labels)
    grid = dim.select(F.col("label").alias("gold")).crossJoin(F.broadcast(dim.select(F.col("label").alias("pred"))))  # labels squared
    return grid.join(counts, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def row_normalised(matrix: DataFrame) -> DataFrame:
    """confusion with share: n over its gold label's total, 0 in an empty row."""
    total = F.sum("n").over(Window.partitionBy("gold"))
    return matrix.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col("n") / total))


def per_class(counts: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """label, precision, recall, f1 and support; each ratio is 0 where its divisor is."""
    sums = counts.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit("g").alias("side")), F.struct(F.col("pred").alias("label"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("gold") == F.col("pred")).alias("hit"))
    sums = sums.groupBy("x.label").agg(F.sum(F.when(F.col("x.side") == "g", F.col("n"))).alias("support"), F.sum(F.when(F.col("x.side") == "p", F.col("n"))).alias("predicted"), F.sum(F.when((F.col("x.side") == "g") & F.col("hit"), F.col("n"))).alias("tp"))
    df = label_table(counts, labels).join(sums, "label", "left").fillna(0, ["support", "predicted", "tp"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    df = df.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return df.select("label", "precision", "recall", f1.alias("f1"), "support")


def macro_f1(classes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: the mean f1 over these labels, all of them."""
    return classes.filter(F.col("label").isin(*labels)).agg((F.sum("f1") / len(labels)).alias("macro_f1"))


def macro_f1_both(classes: DataFrame) -> DataFrame:
    six = F.sum(F.when(F.col("label").isin(*TARGETS), F.col("f1"))) / len(TARGETS)
    return classes.agg(six.alias("macro_f1_6"), (F.sum("f1") / len(LABELS)).alias("macro_f1_7"))


def argmax_conflicts(predictions: DataFrame) -> DataFrame:
    """Predictions whose label has not the highest of its scores (a map); ties are no conflict."""
    best = F.array_max(F.map_values("scores"))
    return predictions.filter(F.col("scores").isNotNull() & (F.try_element_at("scores", F.col("label")) < best))


def seed_statistics(runs: DataFrame, value: str = "macro_f1") -> DataFrame:
    """n, mean and sample standard deviation over runs."""
    return runs.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def best_epoch(history: DataFrame, by: list[str], value: str = "score", epoch: str = "epoch") -> DataFrame:
    """The epoch of the highest value, the earliest of equals."""
    return history.groupBy(*by).agg(F.max_by(epoch, F.struct(F.col(value), -F.col(epoch))).alias("best_epoch"), F.max(value).alias("best_value"))


def softmax(scores: str) -> Column:
    """The softmax of an array column, shifted by its maximum; single precision as the classifier heads are."""
    shifted = F.transform(F.col(scores), lambda x: F.exp((x - F.array_max(scores)).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def combine_stages(stage1: DataFrame, stage2: DataFrame, key: str = "seg_id") -> DataFrame:
    """Scores of two stages to seven: p(other) from the first, p(target) times the rest from the second; the first maximum wins.

    stage1 has p_other and p_target, stage2 p (six probabilities in label order). An id that one of them lacks is an error at run time.
    """
    one, two = stage1.withColumn("_one", F.lit(True)), stage2.withColumn("_two", F.lit(True))
    joined = one.join(two, key, "full_outer").withColumn("p_other", F.when(F.col("_one") & F.col("_two"), F.col("p_other")).otherwise(F.raise_error(F.concat(F.lit("only one stage has "), F.col(key).cast("string"))).cast("double")))
    scores = F.concat(F.transform("p", lambda x: x * F.col("p_target")), F.array("p_other"))
    best = F.array(*map(F.lit, LABELS))[(F.array_position(scores, F.array_max(scores)) - 1).cast("int")]
    return joined.select(key, scores.alias("scores"), best.alias("label"))


def stage_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """stage1: 1 for a target, 0 for other; stage2: index among targets, -100 for other."""
    index = F.array_position(F.array(*map(F.lit, TARGETS)), F.col(label)) - 1
    return df.withColumns({"stage1": (F.col(label) != "other").cast("int"), "stage2": F.when(index < 0, -100).otherwise(index).cast("int")})
