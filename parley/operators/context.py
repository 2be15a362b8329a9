"""Context windows around rows of a stream, and their renderings. Window first, filter afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import LABELS


def with_windows(rows: DataFrame, left: int, right: int, by: str = "meeting", order: str = "position", text: str = "text") -> DataFrame:
    """rows with left and right: texts of so many neighbours, closest first, cut at the stream's ends."""
    w = Window.partitionBy(by).orderBy(order)
    none = F.expr("cast(array() as array<string>)")
    before = F.reverse(F.collect_list(text).over(w.rowsBetween(-left, -1))) if left else none
    after = F.collect_list(text).over(w.rowsBetween(1, right)) if right else none
    return rows.withColumns({"left": before, "right": after})


def format_windows(rows: DataFrame, left: int, right: int, mode: str = "raw", by: str = "meeting", order: str = "position", speaker: str = "speaker_id", text: str = "text") -> DataFrame:
    """by, order and rendered: the window in stream order, one line a row, the target in [T]..[/T].

    mode says how speakers are named: raw, relative (SAME and OTHER) or letters (by appearance in the window). Without any context no
    speaker is named. Only ids, order, speaker and text enter, so labels cannot leak.
    """
    if mode not in ("raw", "relative", "letters"):
        raise ValueError("mode is raw, relative or letters")
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-left, right)
    one = F.struct(F.col(order).alias("at"), F.col(speaker).alias("who"), F.col(text).alias("text"))
    df = rows.select(by, order, F.col(speaker).alias("_who"), F.collect_list(one).over(w).alias("_window"))
    df = df.withColumn("_order", F.array_distinct(F.transform("_window", lambda x: x["who"])))

    def line(x):
        target = x["at"] == F.col(order)
        said = F.when(target, F.concat(F.lit("[T]"), x["text"], F.lit("[/T]"))).otherwise(x["text"])
        if not left and not right:
            return said
        if mode == "raw":
            name = x["who"]
        elif mode == "relative":
            name = F.when(x["who"] == F.col("_who"), "SAME").otherwise("OTHER")
        else:
            name = T.window_letter(F.array_position("_order", x["who"]) - 1)
        return F.concat(F.lit("Speaker "), name, F.lit(": "), said)

    return df.select(by, order, F.array_join(F.transform("_window", line), "\n").alias("rendered"))


def segment_items(rows: DataFrame, left: int, right: int, keep: Sequence[str] | None = None, test: bool = False, labels: Sequence[str] = LABELS) -> DataFrame:
    """rows as a model sees them: seg_id, meeting, position, target_text, left, right, label and label_index.

    Windows are made before keep drops rows of other labels. Rows of the test split have no label; elsewhere a label outside labels is an error at run time.
    """
    df = with_windows(rows, left, right)
    if keep is not None:
        df = df.filter(F.col("label").isin(*keep))
    unknown = F.concat(F.lit("a label outside the label set at "), F.col("seg_id").cast("string"))
    label = F.lit(None).cast("string") if test else F.when(F.col("label").isin(*labels), F.col("label")).otherwise(F.raise_error(unknown).cast("string"))
    df = df.select("seg_id", "meeting", "position", F.col("text").alias("target_text"), "left", "right", label.alias("label"))
    return df.withColumn("label_index", (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("int"))
