"""Releases, gold labels, predictions and metrics as files.

A release is a folder of rows.jsonl, links.jsonl, splits.json, metadata.json and checksums.sha256. Files are published once and never
overwritten: they are staged beside the target and renamed. The driver writes these few small files; rows come to it in order, one at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batching, checks, metrics
from ..schemas import LABELS, LINK, RELEASED, SPLITS, STATUSES
from .jsonl import raise_bad, read_exact, read_jsonl, read_lines, to_lines, what_is_wrong

CONTENT = ("links.jsonl", "metadata.json", "rows.jsonl", "splits.json")
VERSION = r"v[1-9][0-9]*"


def file_sha256(path: str | os.PathLike) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 and n_lines of files of under 2 GB each, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("n_lines"))


def compare_hashes(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name and state: matches, DIFFERS or missing, for each expected (name, sha256)."""
    joined = expected.select("name", F.col("sha256").alias("want")).join(found.select("name", "sha256"), "name", "left")
    return joined.select("name", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("want"), "matches").otherwise("DIFFERS").alias("state"))


def compare_manifests(found: Mapping, expected: Mapping) -> dict[str, str]:
    """matches, DIFFERS or missing for each file that an expected manifest names, and for the archive and the release as a whole."""
    state = lambda got, want: "missing" if got is None else "matches" if got == want else "DIFFERS"
    out = {name: state(found["files"].get(name, {}).get("sha256"), entry["sha256"]) for name, entry in expected["files"].items()}
    return {**{k: state(found.get(k), expected[k]) for k in ("source_archive_sha256", "release_fingerprint") if k in expected}, **out}


def require_same(found: Mapping, expected: Mapping) -> None:
    """Raises unless a build gave what the expected manifest records."""
    other = {k: v for k, v in compare_manifests(found, expected).items() if v != "matches"}
    if other:
        raise ValueError("the build is not the recorded one: " + ", ".join(f"{k} {v}" for k, v in sorted(other.items())))


def release_counts(rows: DataFrame, links: DataFrame) -> dict:
    """The counts of a release's metadata; every label, split and status is there, absent ones with 0."""
    as_dict = lambda df: {r[0]: r[1] for r in df.collect()}  # noqa: E731  a row for each label, split, status or flag
    order = lambda names, got: {x: got[x] for x in names}
    return {
        "total_rows": rows.count(), "total_links": links.count(),
        "rows_by_split": order(SPLITS, as_dict(batching.counts_with_zeros(rows, "split", SPLITS))), "rows_by_label": order(LABELS, as_dict(batching.counts_with_zeros(rows, "label", LABELS))),
        "links_by_status": order(STATUSES, as_dict(batching.counts_with_zeros(links, "status", STATUSES))), "rows_by_quality_flag": dict(sorted(as_dict(batching.flag_counts(rows).select("flag", "rows")).items())),
    }


def _write_lines(df: DataFrame, order: list[str], path: Path) -> None:
    with open(path, "x", encoding="utf-8", newline="\n") as f:
        for row in to_lines(df.orderBy(*order)).toLocalIterator():
            f.write(row["value"] + "\n")


def _write_json(value: object, path: Path) -> None:
    path.write_text(json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2) + "\n", encoding="utf-8", newline="\n")


def make_release(rows: DataFrame, links: DataFrame, splits: DataFrame, k: int, target: str, version: str, source: Mapping[str, object], split_source_sha256: str) -> str:
    """Validate, write, checksum, reload; returns the release's fingerprint, the SHA-256 of its checksum file."""
    out, staged = Path(target), Path(f"{target}.partial")
    if out.exists() or staged.exists():
        raise FileExistsError(f"{target} exists or was left unfinished; releases are never overwritten")
    if not re.fullmatch(VERSION, version):
        raise ValueError("a version is v1, v2 and so on")
    checks.raise_first(checks.check_release_rows(rows, splits, k).unionByName(checks.check_links(rows, links)))
    staged.mkdir(parents=True)
    try:
        _write_lines(rows, ["meeting", "position"], staged / "rows.jsonl")
        keyed = links.join(rows.select(F.col("seg_id").alias("proposal_id"), "meeting", "position"), "proposal_id").select("meeting", "position", *links.columns)
        with open(staged / "links.jsonl", "x", encoding="utf-8", newline="\n") as f:
            for row in keyed.orderBy("meeting", "position").select(F.to_json(F.struct(*links.columns), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator():
                f.write(row["value"] + "\n")
        assigned = {r["meeting"]: {"split": r["split"], "fold": r["fold"]} for r in splits.orderBy("meeting").toLocalIterator()}
        _write_json({"k": k, "grouping": "meeting", "meetings": assigned, "source_sha256": split_source_sha256}, staged / "splits.json")
        _write_json({"data_version": version, "schema_version": "1.0", "source_archive": dict(source), "counts": release_counts(rows, links)}, staged / "metadata.json")
        (staged / "checksums.sha256").write_text("".join(f"{file_sha256(staged / n)}  {n}\n" for n in CONTENT), encoding="utf-8", newline="\n")
        load_release(rows.sparkSession, str(staged))
    except BaseException:
        shutil.rmtree(staged)
        raise
    staged.rename(out)
    return file_sha256(out / "checksums.sha256")


def read_object(path: Path) -> dict:
    """The object of a small JSON file; a repeated key, NaN or another kind of value is an error."""
    text = path.read_text(encoding="utf-8")
    if wrong := what_is_wrong(text):
        raise ValueError(f"{path.name}: {wrong}")
    return json.loads(text)


def verify_checksums(folder: str) -> None:
    root, seen = Path(folder), []
    for line in (root / "checksums.sha256").read_text(encoding="utf-8").splitlines():
        m = re.fullmatch(r"([0-9a-f]{64})  (\S+)", line)
        if not m or m[2] not in CONTENT or m[2] in seen:
            raise ValueError(f"no line of a checksum file: {line!r}")
        seen.append(m[2])
        if file_sha256(root / m[2]) != m[1]:
            raise ValueError(f"{m[2]} is not the file that was released")
    if tuple(seen) != CONTENT:
        raise ValueError(f"checksums.sha256 names {seen}, not {list(CONTENT)}")


def load_release(spark: SparkSession, folder: str) -> dict:
    """rows, links and splits as DataFrames, and metadata; exactly five files, checksums, version and content are verified."""
    names = sorted(os.listdir(folder))
    if names != sorted((*CONTENT, "checksums.sha256")):
        raise ValueError(f"a release has exactly five files, not {names}")
    verify_checksums(folder)
    splits_file, metadata = (read_object(Path(folder) / n) for n in ("splits.json", "metadata.json"))
    if not re.fullmatch(VERSION, str(metadata.get("data_version"))):
        raise ValueError("metadata.data_version must be a version such as v1")
    checks.check_split_file(splits_file)
    rows, links = read_exact(spark, f"{folder}/rows.jsonl", RELEASED), read_exact(spark, f"{folder}/links.jsonl", LINK).drop("line")
    checks.raise_first(checks.check_arrival(rows, ("meeting", "position"), "line"))
    rows = rows.drop("line")
    splits = spark.createDataFrame([(m, x["split"], x["fold"]) for m, x in splits_file["meetings"].items()], "meeting string, split string, fold int")
    checks.raise_first(checks.check_release_rows(rows, splits, splits_file["k"]).unionByName(checks.check_links(rows, links)))
    return {"rows": rows, "links": links, "splits": splits, "metadata": metadata}


def layer2_gold(rows: DataFrame, links: DataFrame, responders: str = "all", segments: str = "first") -> DataFrame:
    """Eligible links with their proposal row's fields and the acceptable answers; chains that do not fit the status are an error at run time."""
    from ..functions.text import acceptable_responses

    fit = links.filter(F.col("status").isin("ok", "no_pair"))
    own = rows.select(F.col("seg_id").alias("proposal_id"), "meeting", "position", "text")
    return fit.join(own, "proposal_id").withColumn("acceptable", acceptable_responses(F.col("responder_chains"), responders, segments, F.col("status")))


def write_meetings(rows: DataFrame, path: str) -> None:
    """A folder for each split and meeting with its rows in order: seg_id, position, speaker, text, label. Never overwrites."""
    out = rows.select("split", "meeting", "seg_id", "position", F.col("speaker_id").alias("speaker"), "text", "label")
    out.repartition("split", "meeting").sortWithinPartitions("split", "meeting", "position").write.mode("errorifexists").partitionBy("split", "meeting").json(path)


def publish_meetings(rows: DataFrame, splits: DataFrame, target: str, version: str, rows_sha256: str) -> dict:
    """Checked meeting files, {split}/{meeting}.jsonl with rows in order, and source.json; staged beside the target and renamed. Never overwrites.

    Files are written by tasks and named by the store's own file system; the driver handles a name for each meeting.
    """
    spark = rows.sparkSession
    Path_ = spark._jvm.org.apache.hadoop.fs.Path
    staged, out = Path_(f"{target.rstrip('/')}.partial"), Path_(target)
    store = out.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(out) or store.exists(staged):
        raise FileExistsError(f"{target} exists or was left unfinished")
    checks.raise_first(checks.check_meeting_files(rows, splits))
    try:
        write_meetings(rows, staged.toString())
        for split in SPLITS:
            store.mkdirs(Path_(staged, split))
            folder = Path_(staged, f"split={split}")
            for meeting in store.listStatus(folder) if store.exists(folder) else ():
                name = spark._jvm.java.net.URLDecoder.decode(meeting.getPath().getName().removeprefix("meeting="), "UTF-8")
                files = [f.getPath() for f in store.listStatus(meeting.getPath()) if f.getPath().getName().startswith("part-")]
                if len(files) != 1 or not store.rename(files[0], Path_(staged, f"{split}/{name}.jsonl")):
                    raise OSError(f"{name} was not written as one file")
            store.delete(folder, True)
        counts = rows.agg(F.count_distinct("meeting").alias("n_meetings"), F.count(F.lit(1)).alias("n_rows")).first().asDict()
        source = {"data_version": version, "rows_sha256": rows_sha256, **counts}
        stream = store.create(Path_(staged, "source.json"))
        stream.write(bytearray(json.dumps(source, indent=2).encode() + b"\n"))
        stream.close()
    except BaseException:
        store.delete(staged, True)
        raise
    store.delete(Path_(staged, "_SUCCESS"), False)
    if not store.rename(staged, out):
        raise OSError(f"{target} could not be published")
    return source


def preflight(raw_root: str, archive: str, target: str, version: str) -> None:
    """Raises before any long stage if the version, an input folder or the archive is missing, or the target is in use."""
    if not re.fullmatch(VERSION, version):
        raise ValueError("a version is v1, v2 and so on")
    for name in ("DialogueActs", "Words", "transcripts"):
        if not os.path.isdir(f"{raw_root}/{name}"):
            raise FileNotFoundError(f"{raw_root} has no folder {name}")
    if not os.path.isfile(archive):
        raise FileNotFoundError(archive)
    if os.path.isdir(target) and os.listdir(target):
        raise FileExistsError(f"{target} is in use; releases are never overwritten")


def verify_archive(archive: str, expected: str) -> str:
    found = file_sha256(archive)
    if found != expected:
        raise ValueError(f"{archive} is not the recorded archive: its SHA-256 is {found}")
    return found


def archive_member(archive: str, name: str, target: str) -> None:
    """Copy one member of a zip file to a file of its own."""
    with zipfile.ZipFile(archive) as z, z.open(name) as source, open(target, "xb") as out:
        shutil.copyfileobj(source, out)


def manifest(root: str, version: str, archive_sha256: str, fingerprint: str, removed: int) -> dict:
    """Hashes of all files under root by relative path, and lines of JSON lines files; the same for the same build."""
    files = {}
    for path in sorted(p for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))):
        entry: dict[str, object] = {"sha256": file_sha256(path)}
        if path.suffix == ".jsonl":
            with open(path, "rb") as f:
                entry["lines"] = sum(1 for _ in f)
        files[path.relative_to(root).as_posix()] = entry
    return {"data_version": version, "source_archive_sha256": archive_sha256, "release_fingerprint": fingerprint, "rows_removed_by_cleaning": removed, "files": files}


def guard_test(path: str, allow_test: bool) -> None:
    if not allow_test and "test" in {os.path.basename(os.path.realpath(path)), os.path.basename(path.rstrip("/")).removeprefix("split=")}:
        raise PermissionError("the test split is read only with allow_test=True")


def load_gold(spark: SparkSession, path: str, allow_test: bool = False) -> DataFrame:
    """seg_id and label of a file or folder: valid, unique and not empty."""
    guard_test(path, allow_test)
    gold = read_jsonl(spark, path, "seg_id string, label string")
    rules = {"seg_id must be a non-empty string": F.col("seg_id") != "", "label is outside the label set": F.col("label").isin(*LABELS)}
    checks.raise_first(checks.violations(gold, "seg_id", rules).unionByName(checks.duplicate_ids(gold, "seg_id")))
    if not gold.limit(1).count():
        raise ValueError(f"{path}: no gold rows")
    return gold


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """seg_id, label and scores (a map or null): exact keys, valid, unique, scores for all or none. May be empty."""
    lines = read_lines(spark, path)
    keys = F.array_sort(F.map_keys(F.from_json("value", "map<string,string>")))
    raise_bad(lines, (F.trim("value") != "") & (F.col("v").isNull() | ~F.coalesce(keys == F.array(F.lit("label"), F.lit("scores"), F.lit("seg_id")), F.lit(False))))
    rows = lines.filter(F.trim("value") != "").select(F.from_json("value", "seg_id string, label string, scores map<string,double>").alias("r")).select("r.*")
    mixed = rows.agg(F.count_if(F.col("scores").isNull()).alias("a"), F.count("scores").alias("b")).first()
    if mixed["a"] and mixed["b"]:
        raise ValueError("scores must be given for all predictions or for none")
    checks.raise_first(checks.violations(rows, "seg_id", checks.prediction_rules()).unionByName(checks.duplicate_ids(rows, "seg_id")))
    return rows


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One file, sorted by seg_id, after validation; never overwrites."""
    checks.raise_first(checks.violations(predictions, "seg_id", checks.prediction_rules()).unionByName(checks.duplicate_ids(predictions, "seg_id")))
    _write_lines(predictions.select("seg_id", "label", "scores"), ["seg_id"], Path(path))


def evaluate(spark: SparkSession, predictions_path: str, split_dir: str, out_path: str, allow_test: bool = False, extra: Mapping[str, object] | None = None) -> dict:
    """Score a prediction file against a split's gold and write metrics.json; extra never replaces a computed field."""
    if os.path.exists(out_path):
        raise FileExistsError(f"{out_path} exists; metrics are never overwritten")
    predictions, gold = load_predictions(spark, predictions_path), load_gold(spark, split_dir, allow_test)
    if bad := metrics.argmax_conflicts(predictions).orderBy("seg_id").limit(1).collect():
        raise ValueError(f"{bad[0]['seg_id']}: the label has not the highest score")
    metrics.check_coverage(gold, predictions)
    counts = metrics.pair_counts(gold, predictions)
    classes = metrics.per_class(counts)
    by_label = {r["label"]: r.asDict() for r in classes.collect()}  # seven rows
    matrix = {(r["gold"], r["pred"]): r for r in metrics.row_normalised(metrics.confusion(counts)).collect()}  # 49 rows
    six = [by_label[x]["f1"] for x in LABELS[:6]]
    with open(Path(split_dir).parent / "source.json", encoding="utf-8") as f:
        source = json.load(f)
    grid = lambda field: [[matrix[g, p][field] for p in LABELS] for g in LABELS]
    result = {
        "split": Path(split_dir).resolve().name, "data_version": source["data_version"], "allow_test": allow_test, "n_segments": sum(r["support"] for r in by_label.values()),
        "primary": {"macro_f1_6": sum(six) / 6}, "per_class": {x: {k: v for k, v in by_label[x].items() if k != "label"} for x in LABELS},
        "macro_f1_7": (sum(six) + by_label["other"]["f1"]) / 7, "confusion": {"labels": list(LABELS), "counts": grid("n"), "row_normalised": grid("share")}, "pr_auc": None,
    }
    for key, value in (extra or {}).items():
        if key in result:
            raise ValueError(f"extra field {key!r} would replace a computed field")
        result[key] = value
    with open(out_path, "x", encoding="utf-8") as f:
        json.dump(result, f, indent=2)
    return result


def append_history(path: str, event: Mapping[str, object]) -> None:
    """One JSON line for each event, flushed."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(event, ensure_ascii=False, allow_nan=False) + "\n")
        f.flush()
