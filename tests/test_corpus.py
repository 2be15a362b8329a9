"""A small corpus from XML to a release, and scores of predictions on it."""

import json

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import annotate, checks, links, parse, splits
from parley.schemas import LABELS
from parley.sources import annotations, jsonl, release

NS = 'xmlns:nite="http://nite.sourceforge.net/"'
WORDS = f"""<?xml version="1.0" encoding="ISO-8859-1"?><nite:root {NS} nite:id="r">
<w nite:id="w1" starttime="0.0" endtime="0.5">Hello</w><vocalsound nite:id="v1" description="laugh"/><w nite:id="w2" starttime="0.5" endtime="1.0">there</w>
<w nite:id="w3" starttime="1.0" endtime="1.4">,</w><w nite:id="w4" starttime="1.4" endtime="2.0">friend</w><skip nite:id="x"/><w nite:id="w1,200">last</w></nite:root>"""
ACTS = f"""<?xml version="1.0"?><nite:root {NS} nite:id="r">
<dialogueact nite:id="d1" starttime="0.000" endtime="2.000" type="s^cs|bk" channel="2C1" participant="me01" adjacency="1a"><nite:child href="Bmr001.A.words.xml#id(w1)..id(w4)"/></dialogueact>
<dialogueact nite:id="d2" starttime="2.000" endtime="3.500" type="aa" channel="c1" participant="me01" adjacency="1b"><nite:child href="Bmr001.A.words.xml#id(w1200)"/></dialogueact>
<dialogueact nite:id="d3" starttime="3.500" endtime="4.000" original-type="z" channel="c1" participant="me01"/>
<dialogueact nite:id="d4" starttime="4.000" endtime="5.000" type="cs|aa" channel="c1" participant="me01"><nite:child href="nonsense"/></dialogueact>
<dialogueact nite:id="d5" starttime="9" endtime="8" type="x" channel="c1" participant="me01"><nite:child href="Bmr001.A.words.xml#id(w4)..id(w1)"/></dialogueact></nite:root>"""


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "Bmr001.A.words.xml").write_text(WORDS, encoding="latin-1")
    (d / "Bmr001.A.dialogue-acts.xml").write_text(ACTS)
    (d / "Bmr001.trans").write_text("Bmr001-c1_0000000_0002000,hello there | friend\nno comma here\n")
    return parse.parse_rows(annotations.read_acts(spark, str(d)), annotations.read_words(spark, str(d)), annotations.read_transcripts(spark, str(d))).cache()


def test_parse(parsed):
    rows = {r["seg_id"]: r for r in parsed.collect()}
    one, two = rows["Bmr001-2C1_0000000_0002000_p1"], rows["Bmr001-2C1_0000000_0002000_p2"]
    assert (one["text"], two["text"]) == ("Hello laugh there ,", "friend")
    assert (one["start"], one["end"], two["start"], two["end"]) == (0.0, 1.4, 1.4, 2.0)
    assert one["timing_method"] == "transcript_word_boundary" and one["part_type"] == "s^cs" and one["quality_flags"] == ["word_time_missing"]
    last = rows["Bmr001-c1_0002000_0003500"]
    assert last["text"] == "last" and last["timing_method"] == "element"
    assert set(rows["Bmr001-c1_0003500_0004000"]["quality_flags"]) == {"no_word_ref", "type_fallback_original"}
    bad = rows["Bmr001-c1_0004000_0005000_p1"]
    assert bad["quality_flags"][0] == "ref_malformed" and bad["words"] == []
    assert set(rows["Bmr001-c1_invalid_d5"]["quality_flags"]) == {"ref_unresolved", "time_invalid"}
    assert sorted(r["position"] for r in rows.values()) == list(range(len(rows)))
    assert checks.check_parsed(parsed.filter(~F.array_contains("quality_flags", "time_invalid"))).filter("rule <> 'positions begin above 0 or leave a gap'").count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("1.5d", " 2.5\t", "NaN", "1e3", "x")], "a string, b string, c string, d string, e string")
    a, b, c, d, e = df.select(*[T.parse_time(F.col(x)) for x in "abcde"]).first()
    assert (a, b, d, e) == (None, 2.5, 1000.0, None) and c != c
    assert spark.range(1).select(T.milliseconds(F.lit("3273.350"))).first()[0] == 3273350
    with pytest.raises(Exception, match="whole milliseconds"):
        spark.range(1).select(T.milliseconds(F.lit("1.0000000001"))).collect()
    assert spark.range(1).select(T.word_text(F.lit("\t  "), F.lit("cough"))).first()[0] == "cough"


@pytest.fixture(scope="module")
def corpus(parsed, tmp_path_factory):
    """Two meetings' worth of annotated, cleaned and released rows, links and splits; each computed once."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark = parsed.sparkSession

    def keep(df, name):
        df.coalesce(1).write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    good = parsed.filter(~F.arrays_overlap("quality_flags", F.array(*map(F.lit, ("ref_malformed", "ref_unresolved", "time_invalid"))))).withColumn("original_type", F.coalesce("original_type", F.lit("")))
    # test meetings are copies under other names
    other = good.withColumns({c: F.regexp_replace(c, "Bmr001", "Bro002") for c in ("seg_id", "meeting")}).withColumn("source_da_id", F.concat(F.lit("o"), F.col("source_da_id")))
    annotated = keep(annotate.annotate_rows(annotate.renumber(good.unionByName(other))), "annotated")
    cleaned = keep(annotate.renumber(annotate.clean_rows(annotated)), "cleaned")
    made = links.build_links(annotated).select("proposal_id", "responder_chains", "has_response", "status", "adjacency_tokens", "pair_group")
    pruned = keep(annotate.prune_chains(made, annotated.filter(annotate.is_dropped()).select("seg_id")), "links")
    given = spark.createDataFrame([("Bmr001", "train", 0), ("Bro002", "test", None)], "meeting string, split string, fold int")
    return annotated, cleaned, pruned, keep(splits.attach_splits(cleaned, given), "rows"), given


def test_release_round_trip(spark, parsed, corpus, tmp_path):
    annotated, cleaned, pruned, rows, given = corpus
    assert checks.check_annotated(annotated.select(*parsed.columns), annotated).count() == 0
    assert checks.check_cleaned(annotated, cleaned.withColumn("position", F.col("position"))).filter("rule <> 'a field was changed'").count() == 0
    source = {"archive_name": "a.zip", "release": "1", "sha256": "0" * 64}
    one = release.make_release(rows, pruned, given, 5, str(tmp_path / "r1"), "v1", source, "0" * 64)
    two = release.make_release(rows, pruned, given, 5, str(tmp_path / "r2"), "v1", source, "0" * 64)
    assert one == two
    with pytest.raises(FileExistsError):
        release.make_release(rows, pruned, given, 5, str(tmp_path / "r1"), "v1", source, "0" * 64)
    loaded = release.load_release(spark, str(tmp_path / "r1"))
    assert loaded["metadata"]["counts"]["total_rows"] == rows.count() == loaded["rows"].count()
    gold = release.layer2_gold(loaded["rows"], loaded["links"]).collect()
    assert {tuple(r["acceptable"]) for r in gold if r["status"] == "ok"} == {("Bmr001-c1_0002000_0003500",), ("Bro002-c1_0002000_0003500",)}
    (tmp_path / "r1" / "rows.jsonl").write_text("{}\n")
    with pytest.raises(ValueError, match="not the file"):
        release.load_release(spark, str(tmp_path / "r1"))


ROW_CASES = [
    ("seg_id", "''", "seg_id is empty"), ("position", "-1", "position must be 0 or more"), ("label", "'nope'", "a label is outside the label set"), ("target_tags", "array('aa', 'cs')", "target_tags must be distinct and sorted as labels are"),
    ("is_multi_target", "true", "is_multi_target must tell two or more targets"), ("split", "'dev'", "split must be one of the three"), ("fold", "9", "fold must be under k, and null in test"), ("start", "99.0D", "times must rise from src_start over start and end to src_end"),
    ("quality_flags", "array('ref_malformed')", "an act with errors came through"), ("n_parts", "0", "part_index must be under n_parts"), ("meeting", "cast(null as string)", "meeting is missing"),
]


@pytest.mark.parametrize("field,value,rule", ROW_CASES)
def test_row_mutations(corpus, field, value, rule):
    _, _, _, rows, given = corpus
    broken = rows.withColumn(field, F.expr(value))
    assert rule in {r["rule"] for r in checks.check_release_rows(broken, given, 5).collect()}


LINK_CASES = [
    ("status", "'what'", "unknown status"), ("has_response", "false", "has_response must tell whether there are chains"), ("responder_chains", "array(cast(array() as array<string>))", "a responder chain is empty"),
    ("responder_chains", "array(array('ghost'))", "a chain holds an unknown seg_id"), ("pair_group", "cast(null as string)", "an ok record has no pair_group"), ("proposal_id", "'ghost'", "a link has no proposal row"), ("proposal_id", "'ghost'", "a proposal has no link"),
]


@pytest.mark.parametrize("field,value,rule", LINK_CASES)
def test_link_mutations(corpus, field, value, rule):
    _, _, pruned, rows, _ = corpus
    assert rule in {r["rule"] for r in checks.check_links(rows, pruned.withColumn(field, F.expr(value))).collect()}


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"seg_id":"a","label":"cs"}\n\n{"seg_id":"b","label":"other"}\n')
    assert jsonl.read_jsonl(spark, str(p), "seg_id string, label string").count() == 2
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, str(p), "seg_id string", strict=True)
    p.write_text('{"seg_id":"a","seg_id":"b"}\n')
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, str(p), "seg_id string")


def test_evaluate(spark, tmp_path):
    """Three gold rows, one wrong: worked out by hand."""
    (tmp_path / "val").mkdir()
    (tmp_path / "source.json").write_text('{"data_version":"v1"}')
    (tmp_path / "val" / "m.jsonl").write_text("".join(json.dumps({"seg_id": s, "label": x}) + "\n" for s, x in (("a", "cs"), ("b", "cs"), ("c", "other"))))
    scores = lambda x: {y: 0.4 if y == x else 0.1 for y in LABELS}
    predictions = tmp_path / "p.jsonl"
    release.write_predictions(spark.createDataFrame([(s, x, scores(x)) for s, x in (("c", "cs"), ("a", "cs"), ("b", "other"))], "seg_id string, label string, scores map<string,double>"), str(predictions))
    assert [json.loads(x)["seg_id"] for x in predictions.read_text().splitlines()] == ["a", "b", "c"]
    result = release.evaluate(spark, str(predictions), str(tmp_path / "val"), str(tmp_path / "m.json"), extra={"seed": 1})
    assert result["primary"]["macro_f1_6"] == pytest.approx(0.5 / 6) and result["macro_f1_7"] == pytest.approx(0.5 / 7) and result["n_segments"] == 3
    assert result["confusion"]["counts"][0][0] == 1 and result["seed"] == 1
    with pytest.raises(FileExistsError):
        release.evaluate(spark, str(predictions), str(tmp_path / "val"), str(tmp_path / "m.json"))
    (tmp_path / "test").mkdir()
    with pytest.raises(PermissionError):
        release.load_gold(spark, str(tmp_path / "test"))
    (tmp_path / "val" / "n.jsonl").write_text('{"seg_id":"d","label":"aa"}\n')
    with pytest.raises(ValueError, match="1 missing, e.g. d"):
        release.evaluate(spark, str(predictions), str(tmp_path / "val"), str(tmp_path / "n.json"))


def test_allocate():
    given = splits.allocate({"A": 10, "B": 5}, {"train": 9, "val": 3, "test": 3})
    assert {s: sum(r.values()) for s, r in given.items()} == {"A": 10, "B": 5}
    assert {x: sum(r[x] for r in given.values()) for x in ("train", "val", "test")} == {"train": 9, "val": 3, "test": 3}
    with pytest.raises(ValueError):
        splits.allocate({"A": 10}, {"train": 1, "val": 1, "test": 1})
