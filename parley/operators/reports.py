"""Reports as tables of counts, rendered to Markdown on the driver; each table has a row for each flag, method, label or the like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ERROR_FLAGS
from .batching import before_after, flag_counts, markdown_table
from .links import nearest_reply, notes


def _count(rows: DataFrame, section: str, item) -> DataFrame:
    return rows.groupBy(item.cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "item", "n")


def parse_counts(rows: DataFrame) -> DataFrame:
    """section, item, n: rows by number of parts and timing method, flags by row and by act, split rows without text, acts with errors."""
    by_flag = flag_counts(rows)
    error = F.arrays_overlap("quality_flags", F.array(*map(F.lit, ERROR_FLAGS)))
    single = rows.agg(F.count_if((F.col("n_parts") > 1) & (F.col("text") == "")).alias("a"), F.count_distinct(F.when(error, F.col("source_da_id"))).alias("b"))
    parts = [
        _count(rows, "parts", F.col("n_parts")), _count(rows, "timing", F.col("timing_method")),
        by_flag.select(F.lit("flag rows").alias("section"), F.col("flag").alias("item"), F.col("rows").alias("n")), by_flag.select(F.lit("flag acts").alias("section"), F.col("flag").alias("item"), F.col("elements").alias("n")),
        single.select(F.lit("all").alias("section"), F.lit("split rows without text").alias("item"), F.col("a").alias("n")), single.select(F.lit("all").alias("section"), F.lit("acts with errors").alias("item"), F.col("b").alias("n")),
    ]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def annotation_counts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """section, item, n: labels, labels that the variant shifts, combinations of several targets, chains a link, replies by distance."""
    parts = [
        _count(rows, "label", F.col("label")), _count(rows.filter("label <> label_bk_merged"), "shifted", F.concat_ws(" to ", "label", "label_bk_merged")),
        _count(rows.filter("is_multi_target"), "several targets", F.array_join("target_tags", "+")), _count(links, "status", F.col("status")), _count(links, "chains", F.size("responder_chains")),
    ]
    from ..functions.text import distance_bucket

    placed = links.drop("position").join(rows.select(F.col("seg_id").alias("proposal_id"), "position"), "proposal_id")
    parts.append(_count(nearest_reply(placed, rows), "distance", distance_bucket(F.col("distance"))))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def cleaning_counts(annotated: DataFrame, links: DataFrame, cleaned: DataFrame, cleaned_links: DataFrame) -> DataFrame:
    """section, item, before, after: labels, link statuses, rows by reason of their dropping, and links that lost replies."""
    labels = before_after(annotated, cleaned, "label").select(F.lit("label").alias("section"), F.col("label").alias("item"), "before", "after")
    statuses = before_after(links, cleaned_links, "status").select(F.lit("status").alias("section"), F.col("status").alias("item"), "before", "after")
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("is_nonspeech", "is_nonlabeled", "is_empty")]))
    dropped = annotated.select(F.explode(reasons).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("before"))
    n = F.size(F.flatten("responder_chains"))
    both = links.select("proposal_id", n.alias("a")).join(cleaned_links.select("proposal_id", n.alias("b")), "proposal_id")
    lost = both.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.expr("a > b")).alias("after")).select(F.lit("links").alias("section"), F.lit("kept, of these with fewer replies").alias("item"), "before", "after")
    return labels.unionByName(statuses).unionByName(dropped.select(F.lit("dropped").alias("section"), "item", "before", F.lit(0).cast("long").alias("after"))).unionByName(lost)


def render(title: str, counts: DataFrame) -> str:
    """Markdown, in order of sections and items, hence the same for the same counts."""
    return f"# {title}\n\n" + markdown_table(counts, "Counts")


def reach(counts: DataFrame) -> DataFrame:
    """replies, within (those no more than five rows after their proposal) and share, null where there are no replies, from annotation_counts."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = counts.filter("section = 'distance'").agg(n(F.lit(True)).alias("replies"), n(F.col("item") == "<=5").alias("within"))
    return found.withColumn("share", F.col("within") / F.nullif("replies", F.lit(0)))


def annotation_report(rows: DataFrame, links: DataFrame, expected: dict[str, int] | None = None) -> str:
    """Markdown: counts, what a model that sees the next five rows can reach, notes on pairs, and how counts compare with those expected.

    expected names a section, or a section and an item with a slash between them, and the number that belongs there.
    """
    counts = annotation_counts(rows, links).cache()  # a row for each label, status and the like
    out = [render("Annotation", counts)]
    r = reach(counts).first()
    out.append(f"## Reach\n\n{r['within']} of {r['replies']} replies come within five rows" + ("" if r["share"] is None else f", {100 * r['share']:.1f} %") + ".\n")
    out.append("## Notes on pairs\n\n" + "".join(f"- {k}: {v}\n" for k, v in sorted(notes(rows).first().asDict().items())))
    if expected:
        found: dict[str, int] = {}
        for row in counts.collect():
            for name in (row["section"], f"{row['section']}/{row['item']}"):
                found[name] = found.get(name, 0) + row["n"]
        out.append("## Against what was expected\n\n" + "".join(f"- {k}: {found.get(k, 0)}, expected {n}: {'the same' if found.get(k, 0) == n else 'OTHER'}\n" for k, n in sorted(expected.items())))
    counts.unpersist()
    return "\n".join(out)
