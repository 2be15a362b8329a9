"""Predictions of a classifier on texts: the model runs in Arrow batches, what follows from its scores is column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..schemas import LABELS
from .metrics import softmax

Model = Callable[[list[str]], Sequence[Sequence[float]]]


def predict(items: DataFrame, load: Callable[[], Model], text: str = "rendered", labels: Sequence[str] = LABELS) -> DataFrame:
    """items with scores (softmax of the model's outputs, in order of labels) and label (the first of the greatest).

    load is called once in each task, on its executor, and gives the model: texts to one row of numbers each. A null text is empty.
    """
    columns, at = items.columns, items.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or load()
            rows = [[float(x) for x in r] for r in model([x or "" for x in batch.column(at).to_pylist()])] if batch.num_rows else []
            if any(len(r) != len(labels) for r in rows):
                raise ValueError(f"a model for {len(labels)} labels must give as many scores")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*columns, "scores"])

    raw = items.mapInArrow(run, StructType([*items.schema.fields, StructField("scores", ArrayType(DoubleType()))]))
    scored = raw.withColumn("scores", softmax("scores"))
    best = F.array_position(F.col("scores"), F.array_max("scores")) - 1
    return scored.withColumn("label", F.get(F.array(*map(F.lit, labels)), best.cast("int")))
