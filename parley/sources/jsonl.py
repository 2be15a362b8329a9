"""JSON lines: a tolerant reader that skips blank lines, a strict one, and a deterministic writer."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from ..schemas import PARSED


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at, value and v of each line: v is a variant, null where the line is no JSON, or has a repeated key or a NaN.

    split is where the line's piece of the file begins and at grows along the piece; line_numbers makes numbers of them.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    return spark.read.text(path).select(*place, "value", F.try_parse_json("value").alias("v"))


def line_numbers(some: DataFrame, lines: DataFrame) -> DataFrame:
    """some of lines, with line: their number in their file from 1, blank lines counted, however the file was split for reading.

    Lines are counted a split, and the counts of a file's earlier splits added: a row a split moves, no line does.
    """
    splits = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_low"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return some.join(splits, ["file", "split"]).withColumn("line", F.col("_before") + F.col("at") - F.col("_low") + 1).drop("_before", "_low")


def is_bad(strict: bool = False) -> Column:
    """Whether a line of read_lines is no JSON; if strict, blank lines and values that are no object are bad too."""
    blank = F.trim("value") == ""
    if strict:
        return F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return F.col("v").isNull() & ~blank


def _pattern(kind: DataType) -> str:
    """What schema_of_variant says of values of a type, as a pattern; null fits every type."""
    if isinstance(kind, StructType):
        return "VOID|OBJECT<" + ", ".join(f"{f.name}: (?:{_pattern(f.dataType)})" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    if isinstance(kind, ArrayType):
        return f"VOID|ARRAY<(?:{_pattern(kind.elementType)})>"
    names = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "bigint": "BIGINT", "double": r"BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)"}
    return f"VOID|{names[kind.simpleString()]}"


def fits(schema: str) -> Column:
    """Whether a line of read_lines is an object of exactly the schema's fields and types: text is no number, true is no time, nothing is left out or added."""
    whole = _pattern(StructType.fromDDL(schema)).removeprefix("VOID|")
    return F.coalesce(F.schema_of_variant("v").rlike(f"^{whole}$"), F.lit(False))


def read_exact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows and their line: raises for the first line, by file and number, that is blank, no JSON, or not exactly of the schema. Triggers a job for the check."""
    lines = read_lines(spark, path)
    raise_bad(lines, is_bad(strict=True) | ~fits(schema))
    return line_numbers(lines, lines).select(F.from_json("value", schema).alias("r"), "line").select("r.*", "line")


def bad_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """file, line and value of each bad line."""
    return line_numbers(lines.filter(is_bad(strict)), lines).select("file", "line", "value")


def what_is_wrong(value: str) -> str:
    """Why one line is refused, in words."""

    def once(pairs: list) -> dict:
        names = [k for k, _ in pairs]
        twice = next((k for k in names if names.count(k) > 1), None)
        if twice is not None:
            raise ValueError(f"the key {twice!r} occurs twice")
        return dict(pairs)

    def number(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    try:
        found = json.loads(value, object_pairs_hook=once, parse_constant=number)
    except json.JSONDecodeError as e:
        return f"no JSON, {e.msg} at column {e.colno}" if value.strip() else "a blank line"
    except ValueError as e:
        return str(e)
    return "" if isinstance(found, dict) else "no object"


def raise_bad(lines: DataFrame, bad: Column) -> None:
    """Raises, with file and line, for the first line where bad holds. Triggers a job; numbers are computed only if there is one."""
    if not lines.filter(bad).limit(1).count():
        return
    first = line_numbers(lines.filter(bad), lines).orderBy("file", "line").first()
    raise ValueError(f"{first['file']}:{first['line']}: {what_is_wrong(first['value']) or 'not as expected'}: {first['value'][:80]!r}")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Typed rows; raises for the first bad line, by file and number. Triggers a job for the check."""
    lines = read_lines(spark, path)
    raise_bad(lines, is_bad(strict))
    return lines.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_parsed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Typed parsed rows, without validation."""
    return spark.read.schema(PARSED).json(path)


def _numbers(kind: DataType, column: Column) -> Column | None:
    """Whether a value of this type holds a number that JSON does not have, null where it cannot."""
    if isinstance(kind, DoubleType | FloatType):
        return F.isnan(column) | (F.abs(column) == float("inf"))
    if isinstance(kind, ArrayType) and _numbers(kind.elementType, column) is not None:
        return F.exists(column, lambda x: F.coalesce(_numbers(kind.elementType, x), F.lit(False)))
    if isinstance(kind, MapType) and _numbers(kind.valueType, column) is not None:
        return F.exists(F.map_values(column), lambda x: F.coalesce(_numbers(kind.valueType, x), F.lit(False)))
    if isinstance(kind, StructType):
        parts = [F.coalesce(x, F.lit(False)) for f in kind.fields if (x := _numbers(f.dataType, column[f.name])) is not None]
        return reduce(Column.__or__, parts) if parts else None
    return None


def to_lines(df: DataFrame) -> DataFrame:
    """value: each row as compact JSON, nulls written, fields in column order. NaN and infinite numbers, however deep, are an error at run time."""
    found = [F.when(x, F.lit(f.name)) for f in df.schema.fields if (x := _numbers(f.dataType, F.col(f"`{f.name}`"))) is not None]
    if found:
        wrong = F.raise_error(F.concat(F.lit("no JSON number in "), F.coalesce(*found))).cast("string")
        return df.select(F.when(F.coalesce(*found).isNotNull(), wrong).otherwise(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str], single: bool = True) -> None:
    """Write in a total order; never overwrites. single: one file, for publishing a release of known size."""
    ordered = df.orderBy(*order)
    to_lines(ordered.coalesce(1) if single else ordered).write.mode("errorifexists").text(path)
