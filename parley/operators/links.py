"""Adjacency pairs: groups, responder chains and links, with window functions only.

Rows are those of one or more meetings: meeting, position, seg_id, source_da_id, adjacency_raw, is_layer2_proposal. A token of a side a
opens or continues the pair of its number; one of side b puts its act's segments into a chain of the pair open at that time. A restart of
the numbering closes all pairs, so everything is keyed by the number of restarts so far, and by the number of openings so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def tokens(rows: DataFrame) -> DataFrame:
    """One row for each well-formed token of each act, in order (at, i): with its act's segments and restart epoch."""
    first = F.struct("position", "adjacency_raw")
    acts = rows.groupBy("meeting", "source_da_id").agg(F.min(first).alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("position", "seg_id"))), lambda x: x["seg_id"]).alias("segments"))
    pieces = acts.select("meeting", "source_da_id", "segments", F.col("first.position").alias("at"), F.posexplode(T.adjacency_pieces(F.col("first.adjacency_raw"))).alias("i", "piece"))
    read = pieces.withColumn("t", T.adjacency_token(F.col("piece"))).filter("t IS NOT NULL").select("meeting", "source_da_id", "segments", "at", "i", "t.*")
    opens = (F.col("side") == "a") & (F.col("plus") == 0) & (F.col("speaker").isNull() | (F.col("speaker") == 1))
    plain = F.col("underscores") == 0
    w = Window.partitionBy("meeting").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("meeting").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    read = read.withColumns({"opens": opens, "higher": F.sum(F.when((F.col("side") == "a") & plain & (F.col("number") > 1), 1).otherwise(0)).over(w)})
    first_again = F.col("opens") & plain & (F.col("number") == 1)
    last = F.coalesce(F.last(F.when(first_again, F.col("higher")), ignorenulls=True).over(before), F.lit(0))
    read = read.withColumn("restarts", (first_again & (F.col("higher") > last)).cast("int"))
    return read.withColumn("epoch", F.sum("restarts").over(w))


KEY = ("meeting", "epoch", "number", "underscores")


def grouped_tokens(rows: DataFrame) -> DataFrame:
    """tokens with the number of their group within KEY (0: none is open), and for b tokens the chain they join."""
    w = Window.partitionBy(*KEY).orderBy("at", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*KEY).orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    read = tokens(rows)
    a = F.col("side") == "a"
    none_yet = F.coalesce(F.sum(a.cast("int")).over(before), F.lit(0)) == 0
    read = read.withColumn("orphan", a & ~F.col("opens") & none_yet)
    read = read.withColumn("group_no", F.sum((F.col("opens") | F.col("orphan")).cast("int")).over(w))
    within = Window.partitionBy(*KEY, "group_no").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    explicit = F.when(~a & (F.col("group_no") > 0), F.when(F.col("speaker").isNotNull() | (F.col("plus") == 0), F.coalesce("speaker", F.lit(0))))
    read = read.withColumn("explicit", explicit).withColumn("known", F.collect_set("explicit").over(within))
    bare = ~a & (F.col("group_no") > 0) & F.col("explicit").isNull()
    several = bare & ~F.array_contains("known", 0) & (F.size("known") > 1)
    chain = F.coalesce("explicit", F.when(bare & F.array_contains("known", 0), F.lit(0)), F.when(bare & (F.size("known") == 1), F.get("known", F.lit(0))))
    return read.withColumns({"chain": chain, "unclear": several, "lost": bare & (F.size("known") == 0)})


def pair_groups(rows: DataFrame) -> DataFrame:
    """One row for each group: its KEY and group_no, group_id, is_ambiguous, chains (position of the head, first token, segments) and acts.

    acts are those whose a tokens open or continue the group, with the first such token's place in the act.
    """
    read = grouped_tokens(rows).filter("group_no > 0")
    named = F.concat(F.col("meeting"), F.lit(":"), F.col("number").cast("string"), F.repeat(F.lit("_"), F.col("underscores")), F.lit("@"), F.col("at").cast("string"))
    heads = read.groupBy(*KEY, "group_no").agg(
        F.min(F.when((F.col("side") == "a"), F.struct("at", "i", named.alias("group_id")))).alias("head"), F.max(F.col("orphan") | F.col("unclear")).alias("is_ambiguous"),
        F.collect_list(F.when(F.col("side") == "a", F.struct("source_da_id", "i"))).alias("acts"),
    )
    members = read.filter("chain IS NOT NULL").select(*KEY, "group_no", "chain", "at", "i", F.posexplode("segments").alias("j", "seg_id"))
    once = members.groupBy(*KEY, "group_no", "chain", "seg_id").agg(F.min(F.struct("at", "i", "j")).alias("first"))
    lists = once.groupBy(*KEY, "group_no", "chain").agg(F.array_sort(F.collect_list(F.struct("first", "seg_id"))).alias("m"))
    chains = lists.groupBy(*KEY, "group_no").agg(
        F.array_sort(F.collect_list(F.struct(F.col("m")[0]["first"].alias("first"), F.transform("m", lambda x: x["seg_id"]).alias("segments")))).alias("chains")
    )
    return heads.join(chains, [*KEY, "group_no"], "left").select(*KEY, "group_no", "head.group_id", "is_ambiguous", "chains", "acts")


def build_links(rows: DataFrame) -> DataFrame:
    """One link for each proposal row, see schemas.LINK."""
    groups = pair_groups(rows)
    acts = groups.select("meeting", "group_id", "is_ambiguous", "chains", F.explode("acts").alias("act")).groupBy("meeting", "act.source_da_id", "group_id", "is_ambiguous", "chains").agg(F.min("act.i").alias("i"))
    # a chain is ordered by its head's position; ties by the group's place in the act and the chain's first token
    joined = acts.groupBy("meeting", "source_da_id").agg(F.array_sort(F.collect_list(F.struct("i", "group_id", "is_ambiguous", "chains"))).alias("groups"))
    flat = F.flatten(F.transform(F.filter("groups", lambda g: g["chains"].isNotNull()), lambda g: F.transform(g["chains"], lambda c: F.struct(c["first"]["at"].alias("at"), g["i"].alias("g"), c["first"].alias("first"), c["segments"].alias("segments")))))
    linked = joined.select("meeting", "source_da_id", F.transform(F.array_sort(flat), lambda c: c["segments"]).alias("chains"), F.col("groups")[0]["group_id"].alias("pair_group"), F.exists("groups", lambda g: g["is_ambiguous"]).alias("unclear"))
    proposals = rows.filter("is_layer2_proposal").join(linked, ["meeting", "source_da_id"], "left")
    pieces = T.adjacency_pieces(F.col("adjacency_raw"))
    bad = F.exists(pieces, lambda p: T.adjacency_token(p).isNull())
    chains = F.coalesce("chains", F.expr("cast(array() as array<array<string>>)"))
    status = F.when(bad, "malformed").when(F.coalesce("unclear", F.lit(False)), "ambiguous").when(F.size(chains) > 0, "ok").otherwise("no_pair")
    return proposals.select("meeting", "position", F.col("seg_id").alias("proposal_id"), chains.alias("responder_chains"), (F.size(chains) > 0).alias("has_response"), status.alias("status"), pieces.alias("adjacency_tokens"), "pair_group")


def notes(rows: DataFrame) -> DataFrame:
    """One row: how often numbering restarted, and tokens found no group or chain, or several."""
    read = grouped_tokens(rows)
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return read.agg(
        count(F.col("restarts") == 1).alias("numbering_restarts"), count(F.col("orphan")).alias("a_continuation_without_group"),
        count((F.col("side") == "b") & (F.col("group_no") == 0)).alias("b_without_group"), count(F.col("unclear")).alias("b_continuation_ambiguous"), count(F.col("lost")).alias("b_continuation_without_chain"),
    )


def nearest_reply(links: DataFrame, rows: DataFrame) -> DataFrame:
    """proposal_id and the distance in rows to the nearest chain head after it, null where there is none."""
    at = rows.select(F.col("seg_id").alias("head"), F.col("position").alias("head_at"))
    heads = links.filter("status = 'ok'").select("proposal_id", "position", F.explode(F.transform("responder_chains", lambda c: F.get(c, F.lit(0)))).alias("head")).join(at, "head")
    return heads.groupBy("proposal_id").agg(F.min(F.when(F.col("head_at") > F.col("position"), F.col("head_at") - F.col("position"))).alias("distance"))
