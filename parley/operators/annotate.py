"""Labels, tags and flags of parsed rows; cleaning; links after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import DROP_FLAGS, ERROR_FLAGS, ORDER, PROPOSALS


def annotate_rows(rows: DataFrame) -> DataFrame:
    """rows with the ten annotation fields, in one projection after the tokens."""
    tokens = T.part_tokens(F.col("part_type"))
    clean = ~F.arrays_overlap(F.coalesce("quality_flags", F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, ERROR_FLAGS)))
    only = lambda tag: clean & (F.size("_tokens") == 1) & (F.get("_tokens", F.lit(0)) == tag)
    return (
        rows.withColumn("_tokens", tokens)
        .withColumn("_targets", T.target_tags(F.col("_tokens")))
        .select(
            *rows.columns,
            T.pick_label(F.col("_targets")).alias("label"),
            T.pick_label(T.target_tags(F.col("_tokens"), merge_b=True)).alias("label_bk_merged"),
            F.col("_targets").alias("target_tags"),
            (F.size("_targets") >= 2).alias("is_multi_target"),
            F.arrays_overlap("_targets", F.array(*map(F.lit, PROPOSALS))).alias("is_layer2_proposal"),
            T.general_tags(F.col("_tokens")).alias("general_tags"),
            T.disruption_markers(F.col("_tokens")).alias("disruption_markers"),
            F.coalesce(only("x"), F.lit(False)).alias("is_nonspeech"),
            F.coalesce(only("z"), F.lit(False)).alias("is_nonlabeled"),
            (clean & (F.coalesce("text", F.lit("")) == "")).alias("is_empty"),
        )
    )


def is_dropped() -> Column:
    flags = [F.col(c) for c in DROP_FLAGS]
    return flags[0] | flags[1] | flags[2]


def clean_rows(annotated: DataFrame) -> DataFrame:
    """Rows without a drop flag, and without the flags."""
    return annotated.filter(~is_dropped()).drop(*DROP_FLAGS)


def assign_positions(rows: DataFrame, by: str = "meeting", order: tuple[str, ...] = ORDER, name: str = "position") -> DataFrame:
    """Ranks from 0 within each meeting."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(by).orderBy(*[c for c in order if c != by])) - 1).cast("int"))


def renumber(rows: DataFrame, by: str = "meeting", position: str = "position") -> DataFrame:
    """Positions without gaps, in the same order."""
    return assign_positions(rows, by, (position,), position)


def prune_chains(links: DataFrame, dropped: DataFrame) -> DataFrame:
    """links (proposal_id, responder_chains, ..) without the segments that dropped (seg_id) names, and without links of dropped proposals.

    Chains keep their order and empty ones go; an ok link without any becomes no_pair. Links stay whole: only members are dealt out by segment, and what
    is dropped of a link's members comes back to it.
    """
    kept = links.join(dropped.select(F.col("seg_id").alias("proposal_id")), "proposal_id", "left_anti")
    members = kept.select("proposal_id", F.explode(F.flatten(F.array_compact("responder_chains"))).alias("seg_id"))
    gone = members.join(dropped.select("seg_id"), "seg_id", "left_semi").groupBy(F.col("proposal_id").alias("_of")).agg(F.collect_set("seg_id").alias("_gone"))
    out = kept.join(gone, F.col("proposal_id").eqNullSafe(F.col("_of")), "left")
    is_gone = lambda s: F.coalesce(F.array_contains("_gone", s), F.lit(False))
    left = F.filter(F.transform("responder_chains", lambda c: F.filter(c, lambda s: ~is_gone(s))), lambda c: F.size(c) > 0)
    out = out.withColumn("responder_chains", F.coalesce(F.when(F.col("_gone").isNull(), F.filter("responder_chains", lambda c: F.size(c) > 0)).otherwise(left), F.expr("cast(array() as array<array<string>>)")))
    has = F.size("responder_chains") > 0
    return out.withColumns({"has_response": has, "status": F.when((F.col("status") == "ok") & ~has, "no_pair").otherwise(F.col("status"))}).select(*links.columns)
