"""python -m parley build .. or evaluate ..: from a corpus to a release, and from predictions to scores."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import corpus
from .sources import release


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parley", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build a release; the same input gives the same bytes")
    for name, what in (("raw-root", "folder of DialogueActs, Words and transcripts"), ("archive", "zip file that has the meeting list"), ("sha256", "the archive's recorded hash"), ("work", "folder for the stages' tables"), ("target", "folder of the release, which must not exist"), ("version", "v1, v2 and so on")):
        build.add_argument(f"--{name}", required=True, help=what)
    build.add_argument("--meeting-list", default="metadata.xml", help="the archive's member that names the meetings")
    build.add_argument("--counts", type=json.loads, default=None, metavar="JSON", help="meetings a split")
    build.add_argument("--folds", type=int, default=None)
    build.add_argument("--expect", metavar="FILE", help="a manifest that the build must equal")
    build.add_argument("--manifest", metavar="FILE", help="where to write the manifest, which must not exist")
    score = commands.add_parser("evaluate", help="score predictions against a split's gold")
    for name in ("predictions", "gold", "out"):
        score.add_argument(f"--{name}", required=True)
    score.add_argument("--allow-test", action="store_true")
    return out


def run(spark: SparkSession, argv: Sequence[str]) -> int:
    """0, or 1 where the input is refused; the reason goes to standard error."""
    args = parser().parse_args(argv)
    try:
        if args.command == "evaluate":
            result = release.evaluate(spark, args.predictions, args.gold, args.out, args.allow_test)
            print(f"macro F1 {result['primary']['macro_f1_6']:.4f}")
            return 0
        given = {k: v for k, v in (("counts", args.counts), ("k", args.folds)) if v is not None}
        os.makedirs(args.work, exist_ok=True)
        found = corpus.run(spark, corpus.Build(args.raw_root, args.archive, args.sha256, args.work, args.target, args.version, args.meeting_list, **given))
        if args.manifest:
            with open(args.manifest, "x", encoding="utf-8") as f:
                json.dump(found, f, indent=2, sort_keys=True)
        print(found["release_fingerprint"])
        if args.expect:
            with open(args.expect, encoding="utf-8") as f:
                release.require_same(found, json.load(f))
        return 0
    except (ValueError, OSError) as error:
        print(f"stopped: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    session = SparkSession.builder.appName("parley").getOrCreate()
    try:
        sys.exit(run(session, sys.argv[1:]))
    finally:
        session.stop()
