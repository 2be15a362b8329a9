"""Training on Spark: a multinomial model on TF-IDF, with gradient accumulation, warm-up, decoupled weight decay, clipping and choice of the best epoch.

The model is bounded by its vocabulary, the `size` terms of the most texts, so it is broadcast for each step and lives on the driver between steps. The data does not:
rows stay in a table of one folder a step, a step's tasks each sum their rows' gradients, and partial sums meet in two levels, first in about the square root
of their number of groups, then by block of the weights. The driver receives one sum a block. What a step sees is what a loop over batches would: the mean
over its batches of each batch's mean loss.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace  # noqa: F401  replace is for callers with a plan of their own

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LABELS, TARGETS
from ..sources.shared import written
from . import batching, metrics

BLOCK = 4096  # numbers of one partial sum; a row of the aggregation


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) to (key, terms, tfs)."""
    for batch in batches:
        sizes, said = _lists(batch.column(1))
        coded = said.dictionary_encode()
        width = max(1, len(coded.dictionary))
        at, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(), return_counts=True)
        ends = np.searchsorted(at, np.arange(len(sizes) + 1) * width).astype(np.int32)
        terms = coded.dictionary.take(pa.array(at % width))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], names=[batch.schema.names[0], "terms", "tfs"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The sizes of lists, and all their values."""
    return np.diff(column.offsets.to_numpy()), column.flatten()


def term_counts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, terms and tfs: a row for each key, its distinct terms and how often each occurs; keys without a term may be absent.

    A row's terms are counted where it is read. Only rows that share their key are dealt out. Triggers a job that looks for such rows.
    """
    kind = dict(rows.dtypes)[key]
    counted = lambda df: df.select(key, words(F.col(text)).alias("words")).mapInArrow(_bags, f"`{key}` {kind}, terms array<string>, tfs array<long>")
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_k"))
    if not many.limit(1).count():
        return counted(rows)
    same = F.col(key).eqNullSafe(F.col("_k"))
    each = counted(rows.join(many, same, "left_semi")).select(key, F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf")).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    merged = each.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("x")).select(key, F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))
    return counted(rows.join(many, same, "left_anti")).unionByName(merged)


def vocabulary(counts: DataFrame, n_rows: int, size: int, least: int = 1) -> DataFrame:
    """term, column (from 0), df and idf of the terms of the most rows, ties to the smaller term: at most size rows."""
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(size)
    idf = F.log((1 + F.lit(n_rows)) / (1 + F.col("df"))) + 1
    order = Window.orderBy(F.desc("df"), "term")  # over size rows at most
    return found.select("term", (F.row_number().over(order) - 1).alias("column"), "df", idf.alias("idf"))


def weighted(counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, columns and weights, arrays in order of column: tf times idf, each key's weights of length one. No row leaves its task.

    The vocabulary goes through the driver, as the model does: it is bounded by its size.
    """
    known, kind = terms.select("term", "column", "idf").orderBy("column").collect(), dict(counts.dtypes)[key]
    shared = counts.sparkSession.sparkContext.broadcast(([r["term"] for r in known], np.array([r["column"] for r in known], np.int32), np.array([r["idf"] for r in known])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, columns, idf = shared.value
        names = pa.array(names, pa.string())
        for batch in batches:
            sizes, said = _lists(batch.column(1))
            place = pc.index_in(said, value_set=names).fill_null(-1).to_numpy()
            held = place >= 0
            row, place = np.repeat(np.arange(len(sizes)), sizes)[held], place[held]
            w = _lists(batch.column(2))[1].to_numpy()[held] * idf[place]
            order = np.lexsort((place, row))
            row, place, w = row[order], place[order], w[order]
            w = w / np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            ends = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(columns[place])), pa.ListArray.from_arrays(ends, pa.array(w))], names=[key, "columns", "weights"])

    return counts.select(key, "terms", "tfs").mapInArrow(run, f"`{key}` {kind}, columns array<int>, weights array<double>")


def tf_idf(counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, term, column and weight: tf times idf, each key's weights of length one."""
    pairs = weighted(counts, terms, key).select(key, F.inline(F.arrays_zip("columns", "weights")).alias("column", "weight"))
    return pairs.join(F.broadcast(terms.select("term", "column")), "column").select(key, "term", "column", "weight")  # the vocabulary is bounded by its size


def features(rows: DataFrame, counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """rows with columns and weights, arrays in order of column; both empty where a row has no term of the vocabulary."""
    got = rows.join(weighted(counts, terms, key), key, "left")
    return got.withColumns({"columns": F.coalesce("columns", F.expr("cast(array() as array<int>)")), "weights": F.coalesce("weights", F.expr("cast(array() as array<double>)"))})


@dataclass(frozen=True)
class Plan:
    """How to train. warmup is a share of all steps; schedule is linear, cosine or constant; clip bounds the norm of a step's gradient."""

    epochs: int = 3
    batch_size: int = 32
    accumulate: int = 1
    rate: float = 0.1
    decay: float = 0.01
    warmup: float = 0.1
    clip: float = 1.0
    schedule: str = "linear"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.epochs < 1 or self.accumulate < 1 or self.batch_size < 1:
            raise ValueError("epochs, batch_size and accumulate are at least 1")
        if not 0 <= self.warmup < 1:
            raise ValueError("warmup is a share of the steps, under 1")
        if self.schedule not in ("linear", "cosine", "constant"):
            raise ValueError("schedule is linear, cosine or constant")

    def steps(self, n_batches: int) -> int:
        """Steps of one epoch: the last group of batches may be smaller than the others."""
        return -(-n_batches // self.accumulate)

    def learning_rate(self, step: int, total: int) -> float:
        """The rate of a step, counted from 0: up to rate during warm-up, then down to 0, or level."""
        rise = int(self.warmup * total)
        if step < rise:
            return self.rate * step / rise
        gone = (step - rise) / max(1, total - rise)
        return self.rate * {"linear": 1 - gone, "cosine": (1 + math.cos(math.pi * gone)) / 2, "constant": 1.0}[self.schedule]


@dataclass
class AdamW:
    """Adam with decay of the weights apart from the gradient; the last row, the intercepts, does not decay."""

    shape: tuple[int, int]
    decay: float
    step: int = 0
    first: np.ndarray = field(init=False)
    second: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first, self.second = np.zeros(self.shape), np.zeros(self.shape)

    def update(self, weights: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient * gradient
        kept = np.ones((self.shape[0], 1)) * (1 - rate * self.decay)
        kept[-1] = 1.0
        up = (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)
        return weights * kept - rate * up


def clipped(gradient: np.ndarray, most: float) -> tuple[np.ndarray, float]:
    """gradient scaled to a norm of most where it is longer, and its norm before."""
    norm = float(np.sqrt((gradient * gradient).sum()))
    return gradient * min(1.0, most / (norm + 1e-6)), norm


def probabilities(columns: pa.ListArray, weights: pa.ListArray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column and value of each entry; class probabilities of each row). The model's last row is the intercepts."""
    sizes = np.diff(columns.offsets.to_numpy())
    row, column, value = np.repeat(np.arange(len(sizes)), sizes), columns.flatten().to_numpy(), weights.flatten().to_numpy()
    z = np.stack([np.bincount(row, model[column, k] * value, len(sizes)) for k in range(model.shape[1])], axis=1) + model[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return row, column, value, p / p.sum(axis=1, keepdims=True)


def _partial(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums of its rows' gradients, in blocks, and of their losses as block -1. Each row counts by its share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total, loss, seen = np.zeros_like(model), 0.0, False
        for batch in batches:
            row, column, value, p = probabilities(batch.column("columns"), batch.column("weights"), model)
            y, share = batch.column("y").to_numpy(), batch.column("share").to_numpy()
            at = np.arange(len(y))
            loss -= float((share * np.log(np.maximum(p[at, y], 1e-300))).sum())
            p[at, y] -= 1
            p *= share[:, None]
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(column, p[row, k] * value, len(total))
            total[-1] += p.sum(axis=0)
            seen = True
        if seen:
            flat = total.reshape(-1)
            parts = [(-1, np.array([loss])), *[(i, flat[i * BLOCK : (i + 1) * BLOCK]) for i in range(-(-len(flat) // BLOCK))]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts]), pa.array([x.tobytes() for _, x in parts])], names=["block", "sums"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
    return pa.table({"block": group.column("block")[:1], "sums": pa.array([total.tobytes()])})


def gradient(rows: DataFrame, model: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient and the loss of rows (columns, weights, y, share) at a model, summed where the rows are and then in two levels."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of the vocabulary's size
    partial = rows.select("columns", "weights", "y", "share").mapInArrow(_partial(shared), "block long, sums binary")
    groups = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = partial.withColumn("g", F.spark_partition_id() % groups).groupBy("g", "block").applyInArrow(_summed, "block long, sums binary")
    sums = {r["block"]: np.frombuffer(r["sums"]) for r in first.groupBy("block").applyInArrow(_summed, "block long, sums binary").collect()}  # a row for each block
    shared.destroy()
    if -1 not in sums:
        return np.zeros_like(model), 0.0
    return np.concatenate([sums[i] for i in range(len(sums) - 1)]).reshape(model.shape), float(sums[-1][0])


def step_table(rows: DataFrame, plan: Plan, key: str, length: str = "chars", chunk_batches: int = 50) -> DataFrame:
    """rows with step (from 0), batch and share: what a row's loss weighs in its step. Rows whose y is null or under 0 are left out of the loss.

    A batch's loss is the mean over its labelled rows; a step's is the mean over its batches, of which the last step may have fewer.
    """
    cut = batching.train_batches(rows, plan.batch_size, chunk_batches, key, plan.seed, length).filter("y >= 0")
    labelled = cut.groupBy("batch").agg(F.count(F.lit(1)).alias("_in_batch"))
    sized = labelled.withColumn("step", F.floor(F.col("batch") / plan.accumulate))
    per_step = sized.groupBy("step").agg(F.count(F.lit(1)).alias("_batches"))
    shares = sized.join(per_step, "step").select("batch", "step", (1 / (F.col("_in_batch") * F.col("_batches"))).alias("share"))
    return cut.join(batching.small(shares), "batch")


def written_steps(steps: DataFrame) -> DataFrame:
    """step_table's rows as a table of one folder a step, whose files hold about as much each, however few steps there are."""
    return written(steps.hint("rebalance", F.col("step")), "steps", "step")


def predict(rows: DataFrame, model: np.ndarray, classes: Sequence[str], key: str) -> DataFrame:
    """key, label and scores (a map) of rows with columns and weights; of equal scores the first class counts."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(model), dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probabilities(batch.column("columns"), batch.column("weights"), shared.value)[-1]
            best = pa.array([classes[i] for i in p.argmax(axis=1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(key), best, pa.array(p.tolist(), pa.list_(pa.float64()))], names=[key, "label", "p"])

    scored = rows.select(key, "columns", "weights").mapInArrow(run, f"`{key}` {kind}, label string, p array<double>")
    return scored.select(key, "label", F.map_from_arrays(F.array(*map(F.lit, classes)), "p").alias("scores"))


def train(steps: DataFrame, validation: DataFrame, size: int, classes: Sequence[str], plan: Plan, key: str = "seg_id", select: Sequence[str] | None = None, on_log: Callable[[dict], None] | None = None) -> dict:
    """Train on a table of step_table's rows and keep the best epoch by mean F1 on validation (key, label, columns, weights); a tie keeps the earlier.

    steps should be written by step (written_steps), so that a step reads its own rows. Returns model and best_model (terms and intercepts by classes),
    epoch (from 1) and history: a line for each step and for each epoch.
    """
    batches_in = {r["step"]: r["n"] for r in steps.groupBy("step").agg(F.count_distinct("batch").alias("n")).collect()}  # a row for each step
    total_steps = len(batches_in)
    model, state, history = np.zeros((size + 1, len(classes))), AdamW((size + 1, len(classes)), plan.decay), []
    best = {"epoch": 0, "score": -1.0, "model": model}

    def log(line: dict) -> None:
        history.append(line)
        if on_log:
            on_log(line)

    for epoch in range(1, plan.epochs + 1):
        loss_sum = 0.0
        for step, n_batches in sorted(batches_in.items()):
            rate = plan.learning_rate(state.step, plan.epochs * total_steps)
            up, loss = gradient(steps.filter(F.col("step") == step), model)
            up, norm = clipped(up, plan.clip)
            model = state.update(model, up, rate)
            loss_sum += loss * n_batches
            log({"type": "step", "step": state.step, "epoch": epoch, "train_loss": loss, "rate": rate, "gradient_norm": norm})
        counts = metrics.pair_counts(validation.select(key, "label"), predict(validation, model, classes, key), key)
        by_class = {r["label"]: r["f1"] for r in metrics.per_class(counts, classes).collect()}  # a row for each class
        score = sum(by_class[c] for c in select or classes) / len(select or classes)
        if score > best["score"]:
            best = {"epoch": epoch, "score": score, "model": model}
        log({"type": "epoch", "epoch": epoch, "train_loss": loss_sum / sum(batches_in.values()), "macro_f1": score, "per_class_f1": by_class, "is_best": best["epoch"] == epoch})
    return {"model": model, "best_model": best["model"], "epoch": best["epoch"], "score": best["score"], "history": history}


def two_stages(rows: DataFrame, validation: DataFrame, size: int, plan: Plan, key: str = "seg_id") -> dict:
    """Train a model of target or other and one of the six targets, and combine their scores on validation to seven labels.

    rows and validation have key, label, columns, weights and chars. The second model learns from targets only and is scored on them only. Returns both
    runs (first, second), combined (key, scores, label) and macro_f1 over the six targets.
    """
    other = LABELS[-1]
    is_target = F.col("label") != other
    first_steps = step_table(rows.withColumn("y", is_target.cast("int")), plan, key)
    first = train(written_steps(first_steps), validation.withColumn("label", F.when(is_target, "target").otherwise(other)), size, (other, "target"), plan, key, ("target",))
    own = rows.filter(is_target).withColumn("y", F.array_position(F.array(*map(F.lit, TARGETS)), F.col("label")).cast("int") - 1)
    second = train(written_steps(step_table(own, plan, key)), validation.filter(is_target), size, TARGETS, plan, key)
    one = predict(validation, first["best_model"], (other, "target"), key).select(key, F.col("scores")[other].alias("p_other"), F.col("scores")["target"].alias("p_target"))
    two = predict(validation, second["best_model"], TARGETS, key).select(key, F.transform(F.array(*map(F.lit, TARGETS)), lambda x: F.element_at("scores", x)).alias("p"))
    combined = metrics.combine_stages(one, two, key)
    classes = metrics.per_class(metrics.pair_counts(validation.select(key, "label"), combined, key))
    return {"first": first, "second": second, "combined": combined, "macro_f1": metrics.macro_f1(classes, TARGETS).first()["macro_f1"]}
