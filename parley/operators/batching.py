"""Length-bucketed batches, padded token arrays, and reports on counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..sources.shared import written


def with_length(items: DataFrame, texts: tuple[str, ...] = ("target_text",), lists: tuple[str, ...] = ("left", "right")) -> DataFrame:
    total = sum([F.length(c) for c in texts], F.lit(0)) + sum([F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x)) for c in lists], F.lit(0))
    return items.withColumn("chars", total.cast("bigint"))


def eval_batches(items: DataFrame, batch_size: int, key: str, length: str = "chars") -> DataFrame:
    """items with batch and place: longest first, ties by key, the short batch last.

    The global rank comes from a range sort, counts per partition and offsets, so no task holds more than a share of the items.
    """
    if batch_size < 1:
        raise ValueError("batch_size is at least 1")
    ranked = global_rank(items, [F.col(length).desc(), F.col(key)])
    return ranked.withColumns({"batch": F.floor(F.col("rank") / batch_size), "place": (F.col("rank") % batch_size).cast("int")}).drop("rank")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has so few rows, of a few numbers each; a join on few keys then moves none of the other side's rows. Triggers a job."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with its rank from 0 in a total order, without a single-partition window."""
    columns = df.columns
    # written, since the ranges are used twice and bounds drawn anew might differ
    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = part.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_many"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_many").over(w), F.lit(0)).alias("_from"))
    return inside.join(F.broadcast(offsets), "_part").select(*columns, (F.col("_from") + F.col("_in") - 1).alias(name))


def train_batches(items: DataFrame, batch_size: int, chunk_batches: int, key: str, seed: int = 0, length: str = "chars") -> DataFrame:
    """items with batch (in shuffled order) and place: shuffled by a seeded hash, cut into chunks, sorted by length within a chunk.

    The same for every epoch and however rows are partitioned.
    """
    if batch_size < 1 or chunk_batches < 1:
        raise ValueError("batch_size and chunk_batches are at least 1")
    drawn = lambda start, *by: F.sha2(F.concat_ws(":", F.lit(str(start)), *by), 256)
    size = batch_size * chunk_batches
    ranked = global_rank(items.withColumn("_h", drawn(seed, F.col(key).cast("string"))), [F.col("_h"), F.col(key)])
    chunked = ranked.withColumn("_chunk", F.floor(F.col("rank") / size)).drop("rank")
    # all chunks but the last are full, so that places within them follow from places in all rows, and a chunk may be larger than a task
    placed = global_rank(chunked, [F.col("_chunk"), F.col(length), F.col("_h"), F.col(key)], "_j")
    i = F.col("_j") - F.col("_chunk") * size
    cut = placed.withColumns({"_b": F.floor(i / batch_size), "place": (i % batch_size).cast("int")})
    names = cut.select("_chunk", "_b").distinct().withColumn("_o", drawn(seed + 1, F.col("_chunk").cast("string"), F.col("_b").cast("string")))
    order = global_rank(names, [F.col("_o"), F.col("_chunk"), F.col("_b")], "batch")
    return cut.join(small(order.select("_chunk", "_b", "batch")), ["_chunk", "_b"]).drop("_h", "_j", "_chunk", "_b")


def collate(batched: DataFrame, tokenize: Callable[[list[str]], list[list[int]]], text: str = "rendered", max_tokens: int = 512, pad_id: int = 0, label: str | None = "label_index") -> DataFrame:
    """batched (batch, place, text) with input_ids and attention_mask padded to the batch's longest, label -100 where null, and truncated.

    tokenize runs on Arrow batches of texts in Python; truncation and padding are column expressions.
    """
    columns = batched.columns
    at = columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(tokenize(batch.column(at).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*columns, "_ids"])

    schema = StructType([*batched.schema.fields, StructField("_ids", ArrayType(IntegerType()))])
    df = batched.mapInArrow(encode, schema)
    df = df.withColumns({"truncated": F.size("_ids") > max_tokens, "_ids": F.slice("_ids", 1, max_tokens)})
    df = df.withColumn("_n", F.max(F.size("_ids")).over(Window.partitionBy("batch")))
    pad = lambda value: F.array_repeat(F.lit(value), F.col("_n") - F.size("_ids"))
    df = df.withColumns({"input_ids": F.concat("_ids", pad(pad_id)), "attention_mask": F.concat(F.transform("_ids", lambda _: F.lit(1)), pad(0))}).drop("_ids", "_n")
    return df.withColumn(label, F.coalesce(label, F.lit(-100))) if label in columns else df


def loader(rows: DataFrame, tokenize: Callable[[list[str]], list[list[int]]], left: int, right: int, batch_size: int, train: bool, *, keep: Sequence[str] | None = None, test: bool = False, chunk_batches: int = 50, seed: int = 0, sep: str = " [SEP] ", opening: str = "", closing: str = "", suffix: str = "", max_tokens: int = 512, pad_id: int = 0) -> DataFrame:
    """From rows to padded batches in one plan: windows, labels, length, batches, rendered texts, tokens. For training shuffled, else longest first."""
    from ..functions.text import render_context
    from .context import segment_items

    items = with_length(segment_items(rows, left, right, keep, test))
    cut = train_batches(items, batch_size, chunk_batches, "seg_id", seed) if train else eval_batches(items, batch_size, "seg_id")
    shown = cut.withColumn("rendered", render_context(F.col("left"), F.col("target_text"), F.col("right"), sep, opening, closing, suffix))
    return collate(shown.select("batch", "place", "seg_id", "rendered", "label_index"), tokenize, "rendered", max_tokens, pad_id)


def truncation_counts(collated: DataFrame) -> DataFrame:
    return collated.agg(F.count(F.lit(1)).alias("windows"), F.count_if("truncated").alias("truncated"))


def counts_with_zeros(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """column, n for each of values, absent ones as 0."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return dim.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").fillna(0, ["n"])


def flag_counts(rows: DataFrame, flags: str = "quality_flags", element: str = "source_da_id") -> DataFrame:
    """flag, rows with it, and distinct elements with it."""
    return rows.select(element, F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(element).alias("elements"))


def part_counts(acts: DataFrame, used_type: str = "used_type") -> DataFrame:
    """The number of parts, counted from the source alone."""
    return acts.agg(F.sum(F.size(F.split(used_type, "[|]"))).alias("parts"))


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Counts of column on both sides."""
    count = lambda df, name: df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return count(before, "before").join(count(after, "after"), column, "full_outer").fillna(0, ["before", "after"])


def markdown_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report section from an aggregate; more than most rows are an error. Triggers a job."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{title}: more than {most} rows are no report")
    head = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    return "\n".join([f"## {title}", "", *head, *[f"| {' | '.join(map(str, r))} |" for r in sorted(rows, key=str)], ""])
