"""Lines of JSON files: numbers in errors however files are split, what is refused, and what is written."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parley.schemas import PARSED
from parley.sources import jsonl


def write(path, lines, end="\n"):
    path.write_text("".join(x + end for x in lines), encoding="utf-8", newline="")
    return path


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, end):
    """Files of many splits of a few hundred bytes, with blank, long and non-ASCII lines, have the numbers of a plain reading."""
    rng = random.Random(8)
    wanted = []
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice(['{"x": 1}', "", '{"é": "' + "ü" * rng.randrange(300) + '"}', "{oops", "[1]"]) for _ in range(400)]
        write(tmp_path / name, lines, end)
        wanted += [(name, i + 1, x) for i, x in enumerate(lines) if x == "{oops"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path))
        got = [(r["file"].rsplit("/", 1)[-1], r["line"], r["value"]) for r in jsonl.bad_lines(lines).collect()]
        all_ = jsonl.line_numbers(lines, lines)
        assert lines.rdd.getNumPartitions() > 20 and sorted(got) == wanted
        assert all_.groupBy("file").agg(F.count_distinct("line").alias("d"), F.min("line").alias("a"), F.max("line").alias("b")).select("d", "a", "b").distinct().collect() == [(400, 1, 400)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("line, strict, said", [
    ('{"a": 1, "a": 2}', False, "the key 'a' occurs twice"), ('{"a": NaN}', False, "NaN is no JSON number"), ('{"a": ', False, "no JSON"), ("", True, "a blank line"), ("[1]", True, "no object"), ('{"a": {"b": 1, "b": 1}}', True, "the key 'b' occurs twice"),
])
def test_errors_name_file_line_and_reason(spark, tmp_path, line, strict, said):
    path = write(tmp_path / "x.jsonl", ['{"a": 1}', *([] if strict else [""]), '{"a": 2}', line, '{"a": '])
    with pytest.raises(ValueError, match=rf"x\.jsonl:{3 if strict else 4}: {said}"):
        jsonl.read_jsonl(spark, str(path), "a int", strict)


def test_blank_lines_are_skipped_unless_strict(spark, tmp_path):
    path = write(tmp_path / "x.jsonl", ['{"a": 1}', "  ", '{"a": 2}'])
    assert sorted(r["a"] for r in jsonl.read_jsonl(spark, str(path), "a int").collect()) == [1, 2]
    assert jsonl.read_jsonl(spark, str(write(tmp_path / "none.jsonl", [])), "a int").count() == 0


def test_written_lines_are_read_again(spark, tmp_path):
    """Nulls are written, fields keep their order, rows come in the order given; nothing is overwritten."""
    df = spark.createDataFrame([(2, None, [1.5]), (1, "ü\"\n", [])], "k int, s string, x array<double>")
    jsonl.write_jsonl(df, str(tmp_path / "out"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ['{"k":1,"s":"ü\\"\\n","x":[]}', '{"k":2,"s":null,"x":[1.5]}']
    assert sorted(map(tuple, jsonl.read_jsonl(spark, str(tmp_path / "out"), "k int, s string, x array<double>", strict=True).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(Exception, match="(?i)exist"):
        jsonl.write_jsonl(df, str(tmp_path / "out"), ["k"])


@pytest.mark.parametrize("value", [math.nan, math.inf, -math.inf])
def test_numbers_that_json_lacks_are_not_written(spark, value):
    """Also within arrays, maps and structs."""
    deep = spark.createDataFrame([(1, [{"a": (1.0,)}, {"b": (value,)}])], "k int, x array<map<string, struct<y: double>>>")
    for df in (deep, spark.createDataFrame([(value,)], "v double")):
        with pytest.raises(Exception, match="no JSON number in [xv]"):
            jsonl.to_lines(df).collect()
    assert jsonl.to_lines(spark.createDataFrame([(1.0, None, [None])], "v double, w float, x array<double>")).first()["value"] == '{"v":1.0,"w":null,"x":[null]}'


def test_parsed_rows_are_typed(spark, tmp_path):
    path = write(tmp_path / "rows.jsonl", ['{"seg_id": "m_1", "position": 3, "src_start": 0.5, "words": [{"text": "a", "kind": "w", "start": 0.5, "end": null}], "extra": 1}'])
    df = jsonl.read_parsed_rows(spark, str(path))
    assert len(df.columns) == len(spark.createDataFrame([], PARSED).columns)
    row = df.first()
    assert (row["seg_id"], row["position"], row["words"][0]["text"], row["words"][0]["end"], row["comment"]) == ("m_1", 3, "a", None, None)
