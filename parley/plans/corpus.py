"""From a corpus of annotations to a frozen release, in one call: parse, annotate, link, clean, split, renumber, release.

Each stage's rows are written to Parquet in the shared folder under work, so the next one reads a table, and lost executors cost no more than a stage.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import annotate, checks, links, parse, reports, splits
from ..schemas import LINK
from ..sources import annotations, release


@dataclass(frozen=True)
class Build:
    """Where a build reads and writes. raw_root has DialogueActs, Words and transcripts; archive is the zip file that has the meeting list."""

    raw_root: str
    archive: str
    archive_sha256: str
    work: str
    target: str
    version: str
    meeting_list: str = "metadata.xml"
    counts: Mapping[str, int] = field(default_factory=lambda: dict(splits.COUNTS))
    k: int = splits.FOLDS
    corrections: DataFrame | None = None


def _stage(df: DataFrame, build: Build, name: str) -> DataFrame:
    path = f"{build.work}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def corpus_tables(spark: SparkSession, build: Build) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Acts, words and transcripts."""
    acts, words = annotations.read_acts(spark, f"{build.raw_root}/DialogueActs"), annotations.read_words(spark, f"{build.raw_root}/Words")
    return acts, words, annotations.read_transcripts(spark, f"{build.raw_root}/transcripts", build.corrections)


def parse_corpus(spark: SparkSession, build: Build) -> DataFrame:
    return parse.parse_rows(*corpus_tables(spark, build))


def run(spark: SparkSession, build: Build) -> dict:
    """Build the release; returns its manifest, whose fingerprint and hashes are the same for the same input. Raises at the first broken contract."""
    release.preflight(build.raw_root, build.archive, build.target, build.version)
    archive_sha = release.verify_archive(build.archive, build.archive_sha256)
    parsed = _stage(parse_corpus(spark, build), build, "parsed")
    problems = checks.check_parsed(parsed)
    if checks.is_fatal(parsed, problems):
        unaligned = parse.transcript_problems(*corpus_tables(spark, build)).orderBy("source_da_id").limit(20).collect()
        told = "".join(f"{r['source_da_id']}: {r['reason']} ({r['context']})\n" for r in unaligned)
        raise ValueError("the parse has errors\n" + told + reports.render("Parse", reports.parse_counts(parsed)))
    annotated = _stage(annotate.annotate_rows(parsed), build, "annotated")
    made = _stage(links.build_links(annotated).select(*[c.split(" ")[0] for c in LINK.split(", ")]), build, "links")
    checks.raise_first(checks.check_annotated(parsed, annotated).unionByName(checks.check_links(annotated, made)))
    cleaned = _stage(annotate.clean_rows(annotated), build, "cleaned")
    pruned = _stage(annotate.prune_chains(made, annotated.filter(annotate.is_dropped()).select("seg_id")), build, "cleaned_links")
    checks.raise_first(checks.check_cleaned(annotated, cleaned, made, pruned))
    listed = f"{build.work}/meetings.xml"
    release.archive_member(build.archive, build.meeting_list, listed)
    universe = annotations.read_meeting_ids(spark, listed)
    given = splits.split_provenance(universe, splits.assign_splits(universe, build.counts), build.k)
    given = _stage(given.select("meeting", "split", "fold"), build, "splits")
    rows = _stage(splits.attach_splits(annotate.renumber(cleaned), given), build, "rows")
    source = {"archive_name": build.archive.rsplit("/", 1)[-1], "sha256": archive_sha}
    fingerprint = release.make_release(rows, pruned, given, build.k, build.target, build.version, source, release.file_sha256(listed))
    return release.manifest(build.target, build.version, archive_sha, fingerprint, annotated.count() - cleaned.count())
