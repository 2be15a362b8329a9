"""Checks of whole tables and links, gold that is refused, transcripts that do not fit, and items and batches for models."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import annotate, batching, checks, context, parse
from parley.schemas import LINK
from parley.sources import release


@pytest.mark.parametrize("seed", [1, 2])
def test_row_differences_as_counters(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(rng.randrange(4), rng.choice([None, "x", "y"]), rng.choice([[], ["a"], None])) for _ in range(n)]
    a, b = draw(60), draw(60)
    frame = lambda rows: spark.createDataFrame(rows, "k int, s string, l array<string>")
    key = lambda r: (r[0], r[1], None if r[2] is None else tuple(r[2]))
    wanted = Counter(map(key, a))
    wanted.subtract(map(key, b))
    got = {key(r): r["n"] for r in checks.row_differences(frame(a), frame(b)).collect()}
    assert got == {k: n for k, n in wanted.items() if n}
    assert checks.row_differences(frame(a), frame(a[::-1])).count() == 0 and checks.row_differences(frame(a[:0]), frame(b[:0])).count() == 0


LINKS = [("p1", [["r1", "r2"], ["r3"]], True, "ok", ["1a"], "m:1@0"), ("p2", [["r2"]], True, "ok", ["2a"], "m:2@1"), ("p3", [], False, "no_pair", ["3a"], None)]


def problems(spark, *links):
    """Rules broken by links that claim to be LINKS without r2."""
    dropped = spark.createDataFrame([("r2",)], "seg_id string")
    wanted = annotate.prune_chains(spark.createDataFrame(LINKS, LINK), dropped)
    return sorted(tuple(r) for r in checks.check_pruned(wanted, spark.createDataFrame(list(links), LINK)).collect())


PRUNED = [("p1", [["r1"], ["r3"]], True, "ok", ["1a"], "m:1@0"), ("p2", [], False, "no_pair", ["2a"], "m:2@1"), LINKS[2]]
CHAINS, MARKS = "a link's chains are not the former ones without dropped rows", "tokens or pair_group of a link were changed"


def test_pruned_links_pass(spark):
    assert problems(spark, *PRUNED) == [] == problems(spark, *PRUNED[::-1])


@pytest.mark.parametrize("links, rules", [
    (LINKS, [(CHAINS, "p1"), (CHAINS, "p2"), ("a link's status does not follow from its pruning", "p2")]),
    ([PRUNED[0], PRUNED[2]], [("a link is gone", "p2")]), ([*PRUNED, PRUNED[1]], [("a link was added", "p2")]), ([*PRUNED, ("p9", [], False, "no_pair", [], None)], [("a link was added", "p9")]),
    ([("p1", [["r3"], ["r1"]], *PRUNED[0][2:]), *PRUNED[1:]], [(CHAINS, "p1")]), ([("p1", [["r1", "r3"]], *PRUNED[0][2:]), *PRUNED[1:]], [(CHAINS, "p1")]),
    ([(*PRUNED[0][:4], ["1b"], "m:1@0"), *PRUNED[1:]], [(MARKS, "p1")]), ([(*PRUNED[0][:5], None), *PRUNED[1:]], [(MARKS, "p1")]),
])
def test_pruned_links_that_are_wrong(spark, links, rules):
    assert problems(spark, *links) == sorted(rules)


def test_cleaning_is_checked_with_links(spark):
    rows = [("p1", "a", False, False, False), ("r2", "", False, False, True), ("r1", "b", False, False, False)]
    annotated = spark.createDataFrame(rows, "seg_id string, text string, is_nonspeech boolean, is_nonlabeled boolean, is_empty boolean")
    made = spark.createDataFrame(LINKS, LINK)
    cleaned, pruned = annotate.clean_rows(annotated), spark.createDataFrame(PRUNED, LINK)
    assert checks.check_cleaned(annotated, cleaned, made, pruned).count() == 0
    found = checks.check_cleaned(annotated, cleaned.withColumn("text", F.lit("z")), made, made)
    assert {r["rule"] for r in found.collect()} == {"a field was changed", CHAINS, "a link's status does not follow from its pruning"}


@pytest.mark.parametrize("chains, status, said", [
    ([["r"]], "no_pair", "do not fit"), ([], "ok", "do not fit"), ([["r"]], "malformed", "no gold"), ([["r"]], None, "no gold"), ([[""]], "ok", "holds no id"), ([["r", None]], "ok", "holds no id"), ([None], "ok", "holds no id"), (None, "no_pair", "holds no id"),
])
def test_gold_that_is_refused(spark, chains, status, said):
    df = spark.createDataFrame([(chains, status)], "c array<array<string>>, s string")
    with pytest.raises(Exception, match=said):
        df.select(T.acceptable_responses(F.col("c"), status=F.col("s"))).collect()


def test_layer2_gold_checks_the_status(spark):
    rows = spark.createDataFrame([("p1", "m", 0, "a"), ("p3", "m", 1, "b"), ("p4", "m", 2, "c")], "seg_id string, meeting string, position int, text string")
    fine = spark.createDataFrame([*LINKS, ("p4", [["r"]], True, "ambiguous", [], None)], LINK)
    assert {r["proposal_id"]: r["acceptable"] for r in release.layer2_gold(rows, fine).collect()} == {"p1": ["r1", "r3"], "p3": []}
    with pytest.raises(Exception, match="do not fit"):
        release.layer2_gold(rows, fine.withColumn("status", F.lit("no_pair"))).collect()


def test_field_order(spark):
    df = spark.createDataFrame([], LINK)
    checks.check_field_order(df, LINK)
    for wrong, named in ((df.select(*reversed(df.columns)), "proposal_id"), (df.drop("status"), "status"), (df.withColumn("more", F.lit(1)), "more")):
        with pytest.raises(ValueError, match=named):
            checks.check_field_order(wrong, LINK)


def test_arrival_order(spark):
    """A row out of its place is found wherever partitions end, and rows in place are not."""
    rows = [(i, i // 10, i % 10) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "at int, meeting int, position int").repartition(7)
    assert checks.check_arrival(frame(rows), ("meeting", "position"), "at").count() == 0
    rows[57], rows[200] = (57, 2, 0), (200, 19, 9)
    assert sorted(r["id"] for r in checks.check_arrival(frame(rows), ("meeting", "position"), "at").collect()) == ["200", "57"]


ACT = ("m", "A", 0, "m.A.d0", "1.000", "2.500", "s|s^bk", None, "c1", "me1", None, None, "m.A.words.xml#id(w0)..id(w2)")
ACTS = "meeting string, agent string, element_ordinal int, source_da_id string, start_raw string, end_raw string, raw_type string, original_type string, channel string, participant string, adjacency_raw string, comment string, href string"


@pytest.mark.parametrize("act, renderings, wanted", [
    ({}, None, ("no rendering has pipes", "key m-c1_0001000_0002500; 0 renderings")), ({"start_raw": "x"}, ["a|b"], ("no rendering has pipes", "key no valid time; 0 renderings")),
    ({}, ["two | three", "one two | three | four", "on | e two three"], ("no rendering fits the words", "key m-c1_0001000_0002500; 3 renderings; 1: other words; 2: 3 parts instead of 2; 3: a pipe falls inside a word")),
    ({}, ["no | way", "One, two | three"], None), ({"raw_type": "s"}, None, None), ({"href": None}, None, None), ({"source_da_id": None}, [], ("no rendering has pipes", "key m-c1_0001000_0002500; 0 renderings")),
])
def test_transcript_problems(spark, act, renderings, wanted):
    """Only acts of several parts with words need a rendering; each failure keeps its reason, in the order of trial."""
    names = [c.split(" ")[0] for c in ACTS.split(", ")]
    acts = spark.createDataFrame([tuple({**dict(zip(names, ACT)), **act}.values())], ACTS)
    words = spark.createDataFrame([("m.A.words.xml", i, f"w{i}", t, "w", float(i), i + 0.5) for i, t in enumerate(["one", "two", "three"])], "file string, idx int, norm_id string, text string, kind string, start double, end double")
    transcripts = spark.createDataFrame([("m-c1_0001000_0002500", renderings)] if renderings is not None else [], "key string, renderings array<string>")
    got = [tuple(r) for r in parse.transcript_problems(acts, words, transcripts).collect()]
    assert got == ([] if wanted is None else [(act.get("source_da_id", "m.A.d0") or "an act without an id", *wanted)])
    flagged = parse.parse_rows(acts, words, transcripts).filter(F.array_contains("quality_flags", "ref_unresolved")).count()
    assert flagged == (2 if got else 0)


ROWS = [(f"s{i}", "m" if i < 6 else "n", i % 6, "w " * (i + 1), "cs" if i % 2 else "other", "x") for i in range(11)]


def rows(spark):
    return spark.createDataFrame(ROWS, "seg_id string, meeting string, position int, text string, label string, speaker_id string")


def test_items_hide_labels_of_test_and_refuse_unknown_ones(spark):
    items = {r["seg_id"]: r for r in context.segment_items(rows(spark), 2, 1, keep=("cs",)).collect()}
    assert sorted(items) == ["s1", "s3", "s5", "s7", "s9"] and items["s3"]["left"] == ["w w w ", "w w "] and items["s5"]["right"] == [] and items["s1"]["label_index"] == 0
    assert {(r["label"], r["label_index"]) for r in context.segment_items(rows(spark), 1, 0, test=True).collect()} == {(None, None)}
    with pytest.raises(Exception, match="outside the label set at s0"):
        context.segment_items(rows(spark).withColumn("label", F.when(F.col("seg_id") != "s0", F.col("label")).otherwise("??")), 1, 0).collect()


@pytest.mark.parametrize("train", [True, False])
def test_loader_in_one_call(spark, train):
    """Every row is in one batch; ids are padded to the batch's longest, labels are indices, texts hold their window."""
    tokenize = lambda texts: [[len(w) for w in t.split()] for t in texts]
    got = batching.loader(rows(spark), tokenize, 1, 1, 4, train, opening="<", closing=">", max_tokens=9, pad_id=7).collect()
    sizes = Counter(r["batch"] for r in got)
    assert sorted(r["seg_id"] for r in got) == sorted(r[0] for r in ROWS) and sorted(sizes.values()) == [3, 4, 4]
    for r in got:
        assert r["rendered"].count("<") == 1 and len(r["input_ids"]) == len(r["attention_mask"]) <= 9 and r["label_index"] in (0, 6)
        assert len({len(x["input_ids"]) for x in got if x["batch"] == r["batch"]}) == 1
    if not train:
        longest = [sum(len(x["rendered"]) for x in got if x["batch"] == b) for b in sorted(sizes)]
        assert longest == sorted(longest, reverse=True)
