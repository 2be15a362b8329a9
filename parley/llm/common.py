"""What the operators of this subpackage share: shared storage, joins that survive hot keys, and worker caches."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: the space and U+0009 to U+000D.
SPACE = " \t\n\v\f\r"
SPACE_BYTES = SPACE.encode()
SPACE_CLASS = r"[\x20\x09-\x0D]"
BROADCAST_ROWS = 200_000  # of a few numbers each


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="parley-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_WRITTEN: list[str] = []  # paths that this driver has handed out


def fresh_path(spark: SparkSession, name: str) -> str:
    _WRITTEN.append(f"{shared_folder(spark)}/parley-{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def tables_written() -> int:
    return len(_WRITTEN)


def remove_tables(spark: SparkSession, since: int = 0, but: str | None = None) -> int:
    """Delete the tables written to the shared folder after the first so many, except one; for callers who have their results elsewhere by now."""
    n = 0
    for path in _WRITTEN[since:]:
        if path != but:
            _WRITTEN.remove(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n


def newest_table() -> str:
    return _WRITTEN[-1]


def materialize(df: DataFrame, name: str, *by: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: the result is computed once and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join where a key may hold a third of big's rows.

    small is usually an aggregate that is already dealt out by keys. Joining on a further derived key gives
    both sides an exchange that adaptive execution owns, so it may split a hot partition (or broadcast a small side).
    """
    salt = F.xxhash64(*keys)
    return big.withColumn("_spread", salt).join(small.withColumn("_spread", salt), ["_spread", *keys], how).drop("_spread")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def worker_cache(name: str) -> dict:
    """A dict that lives as long as this Python process, so that tasks that share a worker share it."""
    return sys.__dict__.setdefault("_parley_caches", {}).setdefault(name, {})


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, marks: DataFrame, *keys: str) -> DataFrame:
    """The rows of docs that marks keeps. marks: doc_id, content (xxhash64 of the text), keys, kept and copies.

    Each of docs' rows is named by its doc_id, text and keys; nulls match nulls. Rows that no mark names stay. copies counts the rows
    that a kept mark names, of which one stays: that whose columns, as JSON, come first. Only marks that drop something or have copies are
    joined: up to BROADCAST_ROWS of them are broadcast, so that no text moves; beyond that texts are shuffled once.
    """
    columns, content = docs.columns, free_name(docs, "_content")
    marks = materialize(marks.filter("NOT kept OR copies > 1").select("doc_id", "content", *keys, "kept"), "marks")
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{content}") == F.col("k.content"))
    for key in keys:
        same &= F.col(f"d.{key}").eqNullSafe(F.col(f"k.{key}"))
    found = docs.withColumn(content, F.xxhash64("text")).alias("d").join(marks.alias("k"), same, "left")
    own = [F.col(f"d.`{c}`") for c in columns]
    once = found.filter(F.col("k.kept").isNull()).select(*own)
    if not marks.filter("kept").limit(1).count():
        return once
    row = F.struct(*own)
    repeated = found.filter(F.col("k.kept")).groupBy(F.col("d.doc_id").alias("i"), F.col(f"d.{content}").alias("c"), *[F.col(f"d.{k}").alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(repeated.select("row.*"))
