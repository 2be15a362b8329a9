"""Constraints as tables of violations: rule and id of every broken rule, found in one pass and raised, if wanted, first one first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DROP_FLAGS, ERROR_FLAGS, LABELS, MARKERS, PROPOSALS, RAW_TAGS, SPLITS, STATUSES, TARGETS
from ..sources.shared import written


def _in(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """rule, id for each row and each rule whose column is not true. Null counts as broken."""
    broken = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return df.select(F.col(key).cast("string").alias("id"), F.explode(F.array_compact(F.array(*broken))).alias("rule")).select("rule", "id")


def findings(found: DataFrame, order: str = "id") -> DataFrame:
    """problem, n and the first id of each rule."""
    return found.groupBy(F.col("rule").alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", order).alias("first"))


def raise_first(found: DataFrame) -> None:
    """Raises the first violation by rule and id, if there is any. Triggers a job."""
    rows = found.orderBy("rule", "id").limit(1).collect()
    if rows:
        raise ValueError(f"{rows[0]['id']}: {rows[0]['rule']}")


def duplicate_ids(df: DataFrame, key: str, rule: str | None = None) -> DataFrame:
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return many.select(F.lit(rule or f"{key} is not unique").alias("rule"), F.col(key).cast("string").alias("id"))


def gaps(rows: DataFrame, by: str = "meeting", position: str = "position") -> DataFrame:
    """Groups whose positions are not 0 to n - 1."""
    s = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("low"), F.max(position).alias("high"), F.count_distinct(position).alias("d"))
    return s.filter("low <> 0 OR high <> n - 1 OR d <> n").select(F.lit("positions begin above 0 or leave a gap").alias("rule"), F.col(by).cast("string").alias("id"))


def overlaps(rows: DataFrame, by: Sequence[str] = ("source_da_id",), order: str = "part_index", start: str = "start", end: str = "end") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_next", F.lead(start).over(w)).filter(F.col(end) > F.col("_next")).select(F.lit("parts of an act share time").alias("rule"), F.col(by[-1]).cast("string").alias("id")).distinct()


def in_several(rows: DataFrame, by: str = "meeting", value: str = "split") -> DataFrame:
    """Groups with more than one value."""
    return rows.groupBy(by).agg(F.count_distinct(value).alias("n")).filter("n > 1").select(F.lit(f"{by} is in more than one {value}").alias("rule"), F.col(by).cast("string").alias("id"))


def check_parsed(rows: DataFrame) -> DataFrame:
    times = (F.col("src_start") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("src_end"))
    named = {"a part's times must lie within its act's": times | F.array_contains("quality_flags", "time_invalid"), "part_index must be under n_parts": (F.col("part_index") >= 0) & (F.col("part_index") < F.col("n_parts"))}
    return violations(rows, "seg_id", named).unionByName(duplicate_ids(rows, "seg_id")).unionByName(gaps(rows)).unionByName(overlaps(rows, ("meeting", "source_da_id")))


def annotation_rules() -> dict[str, Column]:
    targets = F.col("target_tags")
    error = F.arrays_overlap("quality_flags", _in(ERROR_FLAGS))
    flags = [F.col(c) for c in DROP_FLAGS]
    return {
        "a label is outside the label set": F.col("label").isin(*LABELS) & F.col("label_bk_merged").isin(*LABELS),
        "target_tags must be distinct and sorted as labels are": targets == F.filter(_in(TARGETS), lambda x: F.array_contains(targets, x)),
        "label does not follow target_tags": F.when(F.size(targets) > 0, F.array_contains(targets, F.col("label"))).otherwise(F.col("label") == LABELS[-1]),
        "is_multi_target must tell two or more targets": F.col("is_multi_target") == (F.size(targets) >= 2),
        "is_layer2_proposal must tell a proposing target": F.col("is_layer2_proposal") == F.arrays_overlap(targets, _in(PROPOSALS)),
        "a marker that the format does not know": F.forall("disruption_markers", lambda x: x.isin(*MARKERS)),
        "general_tags holds a target tag or marker": ~F.exists("general_tags", lambda x: x.isin(*RAW_TAGS, *MARKERS)),
        "the marks of x and z exclude each other": ~(flags[0] & flags[1]),
        "is_empty is set on a row with text": ~flags[2] | (F.col("text") == ""),
        "an error-flagged row carries a drop flag": ~(error & (flags[0] | flags[1] | flags[2])),
    }


def changed_fields(before: DataFrame, after: DataFrame, fields: Sequence[str], key: str = "seg_id") -> DataFrame:
    """Rows whose fields differ, nulls compared as values; and rows on one side only."""
    a, b = before.select(key, F.struct(*fields).alias("a")), after.select(key, F.struct(*fields).alias("b"))
    joined = a.join(b, key, "full_outer")
    rule = F.when(F.col("a").isNull(), "a row was added").when(F.col("b").isNull(), "a row is missing").otherwise("a field was changed")
    return joined.filter(~F.col("a").eqNullSafe(F.col("b"))).select(rule.alias("rule"), F.col(key).cast("string").alias("id"))


def check_annotated(parsed: DataFrame, annotated: DataFrame) -> DataFrame:
    return violations(annotated, "seg_id", annotation_rules()).unionByName(duplicate_ids(annotated, "seg_id")).unionByName(changed_fields(parsed, annotated, [c for c in parsed.columns if c != "seg_id"]))


def check_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Link rules, coverage of proposals, and rules on chain members, which meet the rows in one join."""
    chains = F.col("responder_chains")
    members = F.flatten(chains)
    named = {
        "unknown status": F.col("status").isin(*STATUSES),
        "has_response must tell whether there are chains": F.col("has_response") == (F.size(chains) > 0),
        "a responder chain is empty": F.forall(chains, lambda c: F.size(c) > 0),
        "a seg_id appears twice in the chains": F.size(members) == F.size(F.array_distinct(members)),
        "a no_pair record has a response": (F.col("status") != "no_pair") | ~F.col("has_response"),
        "an ok record has no response": (F.col("status") != "ok") | F.col("has_response"),
        "an ok record has no pair_group": (F.col("status") != "ok") | F.col("pair_group").isNotNull(),
    }
    out = violations(links, "proposal_id", named).unionByName(duplicate_ids(links, "proposal_id"))
    both = rows.filter("is_layer2_proposal").select(F.col("seg_id").alias("proposal_id"), F.lit(1).alias("r")).join(links.select("proposal_id", F.lit(1).alias("l")), "proposal_id", "full_outer")
    out = out.unionByName(both.filter("r IS NULL OR l IS NULL").select(F.when(F.col("l").isNull(), "a proposal has no link").otherwise("a link has no proposal row").alias("rule"), F.col("proposal_id").alias("id")))
    where = rows.select("seg_id", "meeting", "position")
    parts = links.select("proposal_id", F.posexplode("responder_chains").alias("i", "c")).select("proposal_id", "i", F.posexplode("c").alias("j", "seg_id")).join(where, "seg_id", "left")
    home = rows.select(F.col("seg_id").alias("proposal_id"), F.col("meeting").alias("home"))
    parts = parts.join(home, "proposal_id", "left")
    in_chain, heads = Window.partitionBy("proposal_id", "i").orderBy("j"), Window.partitionBy("proposal_id").orderBy("i")
    parts = parts.withColumn("_before", F.lag("position").over(in_chain))
    rule = {
        "a chain holds an unknown seg_id": F.col("meeting").isNotNull(),
        "a chain crosses meetings": F.col("meeting").isNull() | (F.col("meeting") == F.col("home")),
        "a chain is out of order": F.col("_before").isNull() | F.col("position").isNull() | (F.col("_before") < F.col("position")),
    }
    out = out.unionByName(violations(parts, "proposal_id", rule))
    first = parts.filter("j = 0").withColumn("_head", F.lag("position").over(heads))
    return out.unionByName(violations(first, "proposal_id", {"chains are not ordered by first position": F.col("_head").isNull() | F.col("position").isNull() | (F.col("_head") <= F.col("position"))})).distinct()


def row_differences(a: DataFrame, b: DataFrame, *columns: str, by: str | None = None) -> DataFrame:
    """The rows that one side has more often than the other, and n: how often a has it more (under 0: b). Nulls are values, repeats count.

    Each side is summed where it is read, so that one shuffle of distinct rows decides. With by, one of the columns, rows are dealt out by it alone, so that
    what is grouped by it next needs no further shuffle.
    """
    names = list(columns or a.columns)
    both = a.select(*names, F.lit(1).alias("n")).unionByName(b.select(*names, F.lit(-1).alias("n")))
    return (both.repartition(by) if by else both).groupBy(*names).agg(F.sum("n").alias("n")).filter("n <> 0")


def check_pruned(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """Where links differ from those wanted, as wholes: fields, the order of chains and of their members, missing, added and repeated links."""
    fields = ("responder_chains", "has_response", "status", "adjacency_tokens", "pair_group")
    odd = row_differences(wanted, got, "proposal_id", *fields, by="proposal_id")
    side = lambda sign, name: F.max(F.when(F.col("n") * sign > 0, F.struct(*fields))).alias(name)
    both = odd.groupBy("proposal_id").agg(side(1, "w"), side(-1, "g"))
    same = lambda *names: reduce(Column.__and__, [F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}")) for c in names])
    one_side = F.col("w").isNull() | F.col("g").isNull()
    return violations(both, "proposal_id", {
        "a link is gone": F.col("g").isNotNull(),
        "a link was added": F.col("w").isNotNull(),
        "tokens or pair_group of a link were changed": one_side | same("adjacency_tokens", "pair_group"),
        "a link's chains are not the former ones without dropped rows": one_side | same("responder_chains"),
        "a link's status does not follow from its pruning": one_side | same("status", "has_response"),
    })


def check_cleaned(annotated: DataFrame, cleaned: DataFrame, links: DataFrame | None = None, cleaned_links: DataFrame | None = None) -> DataFrame:
    """cleaned must be annotated without the dropped rows, and cleaned_links must be links without them, and nothing else."""
    from .annotate import clean_rows, is_dropped, prune_chains

    out = changed_fields(clean_rows(annotated), cleaned, [c for c in cleaned.columns if c != "seg_id"])
    if links is None or cleaned_links is None:
        return out
    dropped = annotated.filter(is_dropped()).select("seg_id")
    return out.unionByName(check_pruned(prune_chains(links, dropped), cleaned_links))


def check_field_order(df: DataFrame, schema: str) -> None:
    """Raises unless df has the fields of a schema, in their order."""
    wanted = df.sparkSession.createDataFrame([], schema).columns
    if df.columns != wanted:
        first = next((w for w, g in zip(wanted, [*df.columns, *[None] * len(wanted)]) if w != g), None)
        raise ValueError(f"fields differ from the schema's, first at {first or df.columns[len(wanted)]}")


def check_arrival(rows: DataFrame, order: Sequence[str], at: str) -> DataFrame:
    """Rows that come, by at, before one that they should follow in a total order. Ranges of at are compared by their ends, so no task sees all rows."""
    key = F.struct(*order)
    part = written(rows.select(F.col(at).alias("_at"), key.alias("_k")).repartitionByRange("_at").withColumn("_p", F.spark_partition_id()), "arrival")
    inside = Window.partitionBy("_p").orderBy("_at")
    tail = part.groupBy("_p").agg(F.max_by("_k", "_at").alias("_end"))
    earlier = tail.withColumn("_end", F.lag("_end").over(Window.orderBy("_p"))).filter("_end IS NOT NULL")  # a row for each partition
    seen = part.withColumn("_before", F.lag("_k").over(inside)).join(F.broadcast(earlier), "_p", "left")
    wrong = F.coalesce("_before", "_end") >= F.col("_k")
    return seen.filter(wrong).select(F.lit("rows arrive out of order").alias("rule"), F.col("_at").cast("string").alias("id"))


def check_release_rows(rows: DataFrame, splits: DataFrame, k: int) -> DataFrame:
    """Rules on released rows and their split assignments (meeting, split, fold)."""
    text_fields = [c for c in ("meeting", "agent", "channel", "source_da_id", "original_type", "part_type", "timing_method") if c in rows.columns]
    named = {f"{c} is missing": F.col(c).isNotNull() for c in text_fields}
    targets, flags = F.col("target_tags"), F.col("quality_flags")
    fold = F.col("fold")
    named |= {
        **{f"{c} is missing": F.col(c).isNotNull() for c in ("speaker_id", "text", "words", "general_tags", "disruption_markers", "quality_flags", "target_tags") if c in rows.columns},
        **{f"{c} is not finite": F.abs(F.col(c)) < float("inf") for c in ("src_start", "src_end", "start", "end")},  # NaN is greater than any number
        "element_ordinal must be 0 or more": F.col("element_ordinal") >= 0,
        "a word lacks its text or kind": F.forall("words", lambda w: w["text"].isNotNull() & w["kind"].isNotNull()),
        "a tag or flag is null": ~(F.exists("general_tags", lambda x: x.isNull()) | F.exists("disruption_markers", lambda x: x.isNull()) | F.exists(flags, lambda x: x.isNull())),
        "a target tag is no target": F.forall(targets, lambda x: F.coalesce(x.isin(*TARGETS), F.lit(False))),
        "seg_id is empty": F.coalesce(F.col("seg_id"), F.lit("")) != "",
        "position must be 0 or more": F.col("position") >= 0,
        "times must rise from src_start over start and end to src_end": (F.col("src_start") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("src_end")),
        "part_index must be under n_parts": (F.col("part_index") >= 0) & (F.col("part_index") < F.col("n_parts")),
        "a label is outside the label set": F.col("label").isin(*LABELS) & F.col("label_bk_merged").isin(*LABELS),
        "target_tags must be distinct and sorted as labels are": targets == F.filter(_in(TARGETS), lambda x: F.array_contains(targets, x)),
        "is_layer2_proposal must tell a proposing target": F.col("is_layer2_proposal") == F.arrays_overlap(targets, _in(PROPOSALS)),
        "is_multi_target must tell two or more targets": F.col("is_multi_target") == (F.size(targets) >= 2),
        "raw_type is null and no flag says why": F.col("raw_type").isNotNull() | F.array_contains(flags, "type_fallback_original"),
        "an act with errors came through": ~F.arrays_overlap(flags, _in(ERROR_FLAGS)),
        "split must be one of the three": F.col("split").isin(*SPLITS),
        "fold must be under k, and null in test": F.when(F.col("split") == "test", fold.isNull()).otherwise(fold.isNotNull() & (fold >= 0) & (fold < k)),
    }
    out = violations(rows, "seg_id", named).unionByName(duplicate_ids(rows, "seg_id")).unionByName(gaps(rows)).unionByName(in_several(rows)).unionByName(in_several(rows, value="fold"))
    at = F.format_string("%s@%s", F.col("meeting"), F.col("position").cast("string"))
    out = out.unionByName(duplicate_ids(rows.select(at.alias("at")), "at", "two rows at one position"))
    own = rows.groupBy("meeting").agg(F.min("split").alias("own_split"), F.min("fold").alias("own_fold"), F.lit(1).alias("r"))
    both = own.join(splits.withColumn("s", F.lit(1)), "meeting", "full_outer")
    agree = {"a declared meeting has no rows": F.col("r").isNotNull(), "rows of an undeclared meeting": F.col("s").isNotNull()}
    agree["rows disagree with the split assignment"] = F.col("r").isNull() | F.col("s").isNull() | (F.col("own_split").eqNullSafe(F.col("split")) & F.col("own_fold").eqNullSafe(F.col("fold")))
    return out.unionByName(violations(both, "meeting", agree))


def check_split_file(splits: Mapping[str, object]) -> None:
    """Raises unless the object of a splits file has a fold count, the grouping, assignments and a source hash."""
    k, source = splits.get("k"), splits.get("source_sha256")
    if type(k) is not int or k < 2:
        raise ValueError("k must be an integer of at least 2")
    if splits.get("grouping") != "meeting":
        raise ValueError("grouping must be by meeting")
    if not isinstance(splits.get("meetings"), Mapping):
        raise ValueError("meetings must map ids to a split and a fold")
    if not isinstance(source, str) or len(source) != 64 or set(source) - set("0123456789abcdef"):
        raise ValueError("source_sha256 must be 64 lower-case hex digits")


def window_rules() -> dict[str, Column]:
    """Rules on rows that context windows are made of."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return {"seg_id is empty": said("seg_id"), "meeting is empty": said("meeting"), "position must be 0 or more": F.col("position") >= 0, "speaker_id is empty": said("speaker_id"), "text is missing": F.col("text").isNotNull()}


def check_windows(rows: DataFrame) -> DataFrame:
    """What a formatter of windows refuses: broken fields, repeated ids, two rows at one position."""
    at = F.format_string("%s@%s", F.col("meeting"), F.col("position").cast("string"))
    return violations(rows, "seg_id", window_rules()).unionByName(duplicate_ids(rows, "seg_id")).unionByName(duplicate_ids(rows.select(at.alias("at")), "at", "two rows at one position"))


def check_meeting_files(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """What a writer of meeting files refuses; drop flags must be false where there are any. splits: meeting, split."""
    named = {"label is outside the label set": F.col("label").isin(*LABELS), "split must be one of the three": F.col("split").isin(*SPLITS)}
    named |= {f"{c} is not false": ~F.col(c) for c in DROP_FLAGS if c in rows.columns}
    own = rows.groupBy("meeting").agg(F.min("split").alias("own"))
    both = own.join(splits.select("meeting", "split"), "meeting", "full_outer")
    agree = {"a declared meeting has no rows": F.col("own").isNotNull(), "rows of an undeclared meeting": F.col("split").isNotNull(), "rows disagree with the split assignment": F.col("own").isNull() | F.col("split").isNull() | (F.col("own") == F.col("split"))}
    return violations(rows, "seg_id", named).unionByName(duplicate_ids(rows, "seg_id")).unionByName(gaps(rows)).unionByName(in_several(rows)).unionByName(violations(both, "meeting", agree))


def is_fatal(rows: DataFrame, *problems: DataFrame) -> bool:
    """Whether a parse must not be used: any problem, or any row with an error flag. Triggers small jobs."""
    bad = rows.filter(F.arrays_overlap("quality_flags", _in(ERROR_FLAGS)))
    return any(df.limit(1).count() > 0 for df in (*problems, bad))


def completion_problems(fresh: DataFrame, previous: DataFrame, parsed: DataFrame, links: DataFrame, key: str = "seg_id") -> DataFrame:
    """Why complete_rows would be wrong: ids that differ, fields that changed, rows to be reused that are proposals or have a link."""
    shared = [c for c in fresh.columns if c not in (key, "split", "fold")]
    both = fresh.select(key, F.struct(*shared).alias("a")).join(previous.select(key, F.struct(*[F.col(c) if c in previous.columns else F.lit(None).alias(c) for c in shared]).alias("b")), key)
    said = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))
    out = duplicate_ids(fresh, key).unionByName(duplicate_ids(previous, key)).unionByName(duplicate_ids(parsed, key)).unionByName(duplicate_ids(links, "proposal_id"))
    out = out.unionByName(said(both.filter(~F.col("a").eqNullSafe(F.col("b"))), "a shared field was changed"))
    out = out.unionByName(said(fresh.join(previous, key, "left_anti"), "a new row was not in the previous release"))
    ids = parsed.select(key, F.lit(1).alias("p")).join(previous.select(key, F.lit(1).alias("q")), key, "full_outer")
    out = out.unionByName(said(ids.filter("p IS NULL OR q IS NULL"), "the previous release has other ids than the parse"))
    reused = previous.join(fresh, key, "left_anti")
    out = out.unionByName(said(reused.filter("is_layer2_proposal"), "a missing row is a proposal"))
    return out.unionByName(said(reused.join(links.select(F.col("proposal_id").alias(key)), key, "left_semi"), "a missing row has a link"))


def complete_rows(fresh: DataFrame, previous: DataFrame, key: str = "seg_id") -> DataFrame:
    """The previous release's rows, without split and fold, with fresh rows' fields where there are any. Check with completion_problems first."""
    columns = [c for c in previous.columns if c not in ("split", "fold")]
    new = fresh.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in fresh.columns if c not in (key, "split", "fold")], F.lit(True).alias("_fresh"))
    own = lambda c: F.when(F.col("_fresh"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fresh.columns and c != key else F.col(c)
    return previous.join(new, key, "left").select(*map(own, columns))


def prediction_rules(tolerance: float = 1e-3) -> dict[str, Column]:
    """Rules on parsed predictions: seg_id, label, scores (a map of doubles, null if none); bad numbers must be null in it."""
    values = F.map_values("scores")
    none = F.col("scores").isNull()
    return {
        "seg_id must be a non-empty string": F.col("seg_id").cast("string") != "",
        "label is outside the label set": F.col("label").isin(*LABELS),
        "scores has wrong keys": none | (F.array_sort(F.map_keys("scores")) == F.array_sort(_in(LABELS))),
        "a score is no number in [0, 1]": none | F.forall(values, lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False))),
        "scores do not sum to one": none | (F.abs(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) - 1) <= tolerance),
    }


def check_totals(rows: DataFrame, expected: DataFrame, by: str = "split") -> DataFrame:
    """by, n and expected wherever counts differ; expected: by, n."""
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    both = got.join(expected.select(by, F.col("n").alias("expected")), by, "full_outer").fillna(0, ["n", "expected"])
    return both.filter("n <> expected")
