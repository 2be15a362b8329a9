"""Annotation XML and transcripts.

Children of a words file have mixed tags and their order matters, which the built-in XML source loses, so files are read whole and
parsed in Python, one at a time; everything after that is native.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import WORD_KINDS

NITE_ID = "{http://nite.sourceforge.net/}id"
RAW_WORDS = "file string, meeting string, agent string, idx int, id string, raw_text string, description string, kind string, start_raw string, end_raw string"
RAW_ACTS = (
    "file string, meeting string, agent string, element_ordinal int, source_da_id string, start_raw string, end_raw string, raw_type string, "
    "original_type string, channel string, participant string, adjacency_raw string, comment string, href string"
)


def _rows(schema: str, read) -> object:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = [pa.int32() if c.strip().endswith(" int") else pa.string() for c in schema.split(",")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                name = posixpath.basename(path)
                meeting, agent = [*name.split("."), ""][:2]
                rows = [(name, meeting, agent, *r) for r in read(ElementTree.fromstring(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return parse


def _words(root: ElementTree.Element) -> Iterator[tuple]:
    idx = 0
    for e in root:
        kind = e.tag.rsplit("}", 1)[-1]
        if kind in WORD_KINDS and e.get(NITE_ID):
            yield idx, e.get(NITE_ID), e.text, e.get("description"), kind, e.get("starttime"), e.get("endtime")
            idx += 1


def _acts(root: ElementTree.Element) -> Iterator[tuple]:
    acts = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "dialogueact"]
    for ordinal, e in enumerate(acts):
        child = next((c for c in e if c.tag.rsplit("}", 1)[-1] == "child"), None)
        yield (ordinal, e.get(NITE_ID), e.get("starttime"), e.get("endtime"), e.get("type"), e.get("original-type"), e.get("channel"), e.get("participant"), e.get("adjacency"), e.get("comment"), None if child is None else child.get("href"))


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """file, meeting, agent, idx, norm_id, text, kind, start, end of every word-like element with an id, in document order."""
    raw = _files(spark, path, "*.words.xml").mapInArrow(_rows(RAW_WORDS, _words), RAW_WORDS)
    return raw.select("file", "meeting", "agent", "idx", T.lookup_id(F.col("id")).alias("norm_id"), T.word_text(F.coalesce("raw_text", F.lit("")), F.col("description")).alias("text"), "kind", T.parse_time(F.col("start_raw")).alias("start"), T.parse_time(F.col("end_raw")).alias("end"))


def read_acts(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, "*.dialogue-acts.xml").mapInArrow(_rows(RAW_ACTS, _acts), RAW_ACTS).drop("file")


def read_transcripts(spark: SparkSession, path: str, corrections: DataFrame | None = None) -> DataFrame:
    """key and renderings (the fields with a pipe) of .trans lines; of a key that occurs again the last line counts.

    corrections (key, renderings) replace, and may add keys.
    """
    from pyspark.sql import Window

    lines = spark.read.option("pathGlobFilter", "*.trans").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.split("value", ",", 3).alias("f"))
    lines = lines.filter(F.size("f") > 1).select("file", "n", F.trim(F.col("f")[0]).alias("key"), F.filter(F.slice("f", 2, 2), lambda x: x.contains("|")).alias("renderings"))
    last = lines.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("file"), F.desc("n")))).filter("r = 1").select("key", "renderings")
    if corrections is None:
        return last
    return last.join(corrections.select("key"), "key", "left_anti").unionByName(corrections.select("key", "renderings"))


def read_meeting_ids(spark: SparkSession, path: str) -> DataFrame:
    """meeting: the names under the first observations element; an error if there are none, or one is missing or occurs twice."""
    lists = spark.read.format("xml").option("rowTag", "observations").option("attributePrefix", "_").schema("observation array<struct<_name:string>>").load(path)
    names = lists.withColumn("i", F.monotonically_increasing_id()).orderBy("i").limit(1).select(F.explode("observation").alias("o")).select(F.col("o._name").alias("meeting"))
    if not names.limit(1).count():
        raise ValueError(f"{path} names no observation")
    counted = names.groupBy("meeting").agg(F.count(F.lit(1)).alias("n"))
    bad = F.raise_error(F.lit("an observation's name is missing or occurs twice")).cast("string")
    return counted.select(F.when(F.col("meeting").isNull() | (F.col("n") > 1), bad).otherwise(F.col("meeting")).alias("meeting"))
