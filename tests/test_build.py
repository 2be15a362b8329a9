"""From a corpus of files to a release: two builds are the same to the byte, and what is broken is refused."""

import hashlib
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from parley import __main__ as command
from parley.operators import checks, reports, splits
from parley.plans import corpus
from parley.sources import annotations, release

NS = 'xmlns:nite="http://nite.sourceforge.net/"'
MEETINGS = [f"Bmr{i:03d}" for i in range(1, 5)] + ["Bro001", "Bro002"]
#: id, type, adjacency, words: a proposal, its reply, two whole labels that cleaning drops, an empty act, a plain one.
ACTS = [("d1", "s^cs", "1a", "let us go"), ("d2", "aa", "1b", "yes"), ("d3", "x", "", "laugh"), ("d4", "z", "", "hm"), ("d5", "s", "", ""), ("d6", "s|s^bk", "", "one two")]


def write_corpus(root):
    for name in ("DialogueActs", "Words", "transcripts"):
        (root / name).mkdir(parents=True)
    for meeting in MEETINGS:
        words, acts, n = [], [], 0
        for i, (act, kind, adjacency, said) in enumerate(ACTS):
            ids = []
            for word in said.split():
                words.append(f'<w nite:id="w{n}" starttime="{n}.0" endtime="{n}.5">{word}</w>')
                ids.append(f"w{n}")
                n += 1
            href = f'<nite:child href="{meeting}.A.words.xml#id({ids[0]})..id({ids[-1]})"/>' if ids else ""
            extra = f' adjacency="{adjacency}"' if adjacency else ""
            acts.append(f'<dialogueact nite:id="{meeting}.{act}" starttime="{i * 10}.000" endtime="{i * 10 + 9}.000" type="{kind}" original-type="{kind}" channel="c1" participant="me01"{extra}>{href}</dialogueact>')
        (root / "Words" / f"{meeting}.A.words.xml").write_text(f"<nite:root {NS}>{''.join(words)}</nite:root>")
        (root / "DialogueActs" / f"{meeting}.A.dialogue-acts.xml").write_text(f"<nite:root {NS}>{''.join(acts)}</nite:root>")
        (root / "transcripts" / f"{meeting}.trans").write_text(f"{meeting}-c1_0050000_0059000,one | two\n")
    listed = "".join(f'<observation name="{m}"/>' for m in MEETINGS)
    with zipfile.ZipFile(root / "a.zip", "w") as z:
        z.writestr("metadata.xml", f"<corpus><observations>{listed}</observations><observations><observation name='no'/></observations></corpus>")


def build(root, out, **changes):
    sha = hashlib.sha256((root / "a.zip").read_bytes()).hexdigest()
    given = {"raw_root": str(root), "archive": str(root / "a.zip"), "archive_sha256": sha, "work": str(out / "work"), "target": str(out / "v1"), "version": "v1", "counts": {"train": 4, "val": 1, "test": 1}, "k": 2}
    (out / "work").mkdir(parents=True, exist_ok=True)
    return corpus.Build(**(given | changes))


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    write_corpus(root)
    return root


@pytest.fixture(scope="module")
def built(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("one")
    return out, corpus.run(spark, build(root, out))


def test_two_builds_are_equal(spark, root, built, tmp_path):
    out, manifest = built
    assert corpus.run(spark, build(root, tmp_path)) == manifest
    assert manifest["rows_removed_by_cleaning"] == 3 * len(MEETINGS) and manifest["files"]["rows.jsonl"]["lines"] == 4 * len(MEETINGS)
    loaded = release.load_release(spark, str(out / "v1"))
    assert {r["status"]: r["count"] for r in loaded["links"].groupBy("status").count().collect()} == {"ok": len(MEETINGS)}
    assert {r["split"]: r["count"] for r in loaded["splits"].groupBy("split").count().collect()} == {"train": 4, "val": 1, "test": 1}


def test_refusals(spark, root, built, tmp_path):
    out, _ = built
    with pytest.raises(FileExistsError):
        corpus.run(spark, build(root, out))
    for change, error in (({"version": "3"}, ValueError), ({"raw_root": str(tmp_path)}, FileNotFoundError), ({"archive": str(tmp_path / "no.zip")}, FileNotFoundError), ({"archive_sha256": "0" * 64}, ValueError)):
        with pytest.raises(error):
            corpus.run(spark, build(root, tmp_path / "x", **change))


def test_meeting_files_and_hashes(spark, built, tmp_path):
    out, manifest = built
    loaded = release.load_release(spark, str(out / "v1"))
    source = release.publish_meetings(loaded["rows"], loaded["splits"], str(tmp_path / "m"), "v1", manifest["files"]["rows.jsonl"]["sha256"])
    assert source["n_meetings"] == 6 and source["n_rows"] == 24
    files = sorted(p.relative_to(tmp_path / "m").as_posix() for p in (tmp_path / "m").rglob("*.jsonl"))
    assert [f.split("/")[1] for f in sorted(files, key=lambda f: f.split("/")[1])] == [f"{m}.jsonl" for m in MEETINGS]
    gold = release.load_gold(spark, str(tmp_path / "m" / "train"))
    assert gold.count() == 16
    with pytest.raises(PermissionError):
        release.load_gold(spark, str(tmp_path / "m" / "test"))
    with pytest.raises(FileExistsError):
        release.publish_meetings(loaded["rows"], loaded["splits"], str(tmp_path / "m"), "v1", "0")
    with pytest.raises(ValueError, match="undeclared"):
        release.publish_meetings(loaded["rows"], loaded["splits"].limit(0), str(tmp_path / "n"), "v1", "0")
    hashes = release.file_hashes(spark, str(out / "v1"))
    known = spark.createDataFrame([("rows.jsonl", manifest["files"]["rows.jsonl"]["sha256"]), ("links.jsonl", "0"), ("gone", "0")], "name string, sha256 string")
    assert {r["name"]: r["state"] for r in release.compare_hashes(hashes, known).collect()} == {"rows.jsonl": "matches", "links.jsonl": "DIFFERS", "gone": "missing"}
    assert {r["name"]: r["n_lines"] for r in hashes.collect()}["rows.jsonl"] == 24


def test_reports(spark, built):
    out, _ = built
    table = lambda name: spark.read.parquet(str(out / "work" / name))
    counts = {(r["section"], r["item"]): r["n"] for r in reports.annotation_counts(table("annotated"), table("links")).collect()}
    assert counts["label", "cs"] == counts["label", "aa"] == counts["label", "bk"] == 6 and counts["distance", "<=5"] == 6 and counts["chains", "1"] == 6
    cleaned = {(r["section"], r["item"]): (r["before"], r["after"]) for r in reports.cleaning_counts(table("annotated"), table("links"), table("cleaned"), table("cleaned_links")).collect()}
    assert cleaned["dropped", "is_nonspeech"] == cleaned["dropped", "is_nonlabeled"] == cleaned["dropped", "is_empty"] == (6, 0)
    assert cleaned["links", "kept, of these with fewer replies"] == (6, 0) and cleaned["label", "other"] == (24, 6)
    text = reports.render("Parse", reports.parse_counts(table("parsed")))
    assert text.startswith("# Parse") and "| timing | transcript_word_boundary | 12 |" in text and text == reports.render("Parse", reports.parse_counts(table("parsed")))
    assert not checks.is_fatal(table("parsed")) and checks.is_fatal(table("parsed").withColumn("quality_flags", F.array(F.lit("time_invalid"))))


CASES = [("text", "cast(null as string)", "text is missing"), ("speaker_id", "cast(null as string)", "speaker_id is missing"), ("end", "double('NaN')", "end is not finite"), ("src_end", "double('Infinity')", "src_end is not finite"), ("element_ordinal", "-1", "element_ordinal must be 0 or more"),
         ("words", "array(named_struct('text', cast(null as string), 'kind', 'w', 'start', 0D, 'end', 0D))", "a word lacks its text or kind"), ("general_tags", "array(cast(null as string))", "a tag or flag is null"), ("target_tags", "array('zz')", "a target tag is no target")]


@pytest.mark.parametrize("field,value,rule", CASES)
def test_more_row_rules(spark, built, field, value, rule):
    out, _ = built
    rows, given = (spark.read.parquet(str(out / "work" / x)) for x in ("rows", "splits"))
    assert rule in {r["rule"] for r in checks.check_release_rows(rows.withColumn(field, F.expr(value)), given, 2).collect()}


@pytest.mark.parametrize("change", [{"k": 1}, {"k": True}, {"grouping": "day"}, {"meetings": []}, {"source_sha256": "0"}, {"source_sha256": "G" * 64}])
def test_split_file_rules(change):
    good = {"k": 2, "grouping": "meeting", "meetings": {}, "source_sha256": "0" * 64}
    checks.check_split_file(good)
    with pytest.raises(ValueError):
        checks.check_split_file(good | change)


def test_provenance_and_meeting_ids(spark, tmp_path):
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "meeting string")
    lists = spark.createDataFrame([("c", "train"), ("a", "val"), ("b", "test")], "meeting string, split string")
    reasons = spark.createDataFrame([("a", "by hand")], "meeting string, reason string")
    got = {r["meeting"]: tuple(r)[1:] for r in splits.split_provenance(universe, lists, 2, reasons).collect()}
    assert got == {"a": ("val", "by hand", 0), "b": ("test", "listed in test", None), "c": ("train", "listed in train", 1)}
    with pytest.raises(ValueError, match="in no split"):
        splits.split_provenance(universe, lists.limit(2), 2)
    p = tmp_path / "m.xml"
    p.write_text("<c><observations></observations></c>")
    with pytest.raises(ValueError, match="no observation"):
        annotations.read_meeting_ids(spark, str(p))
    p.write_text('<c><observations><observation name="a"/><observation name="a"/></observations></c>')
    with pytest.raises(Exception, match="occurs twice"):
        annotations.read_meeting_ids(spark, str(p)).collect()


def rewritten(built, tmp_path, name, change):
    """A copy of the release with one file's lines changed and its checksums made anew."""
    folder = shutil.copytree(built[0] / "v1", tmp_path / "v1")
    lines = (folder / name).read_text().splitlines()
    (folder / name).write_text("".join(x + "\n" for x in change(lines)))
    (folder / "checksums.sha256").write_text("".join(f"{release.file_sha256(folder / n)}  {n}\n" for n in release.CONTENT))
    return str(folder)


def fields(n, **values):
    def change(lines):
        row = json.loads(lines[n])
        lines[n] = json.dumps({k: v for k, v in (row | values).items() if v != "GONE"})
        return lines

    return change


FILE_CASES = [
    ("rows.jsonl", fields(2, comment="GONE"), "rows.jsonl:3: not as expected"), ("rows.jsonl", fields(0, more=1), "rows.jsonl:1: not as expected"), ("rows.jsonl", fields(4, start=True), "rows.jsonl:5: not as expected"),
    ("rows.jsonl", fields(0, general_tags="x"), "rows.jsonl:1: not as expected"), ("rows.jsonl", fields(0, words=[{"text": "a"}]), "rows.jsonl:1: not as expected"), ("rows.jsonl", fields(0, text=5), "rows.jsonl:1: not as expected"), ("rows.jsonl", fields(0, position=1.5), "rows.jsonl:1: not as expected"),
    ("rows.jsonl", lambda x: [x[1], x[0], *x[2:]], "2: rows arrive out of order"), ("rows.jsonl", fields(1, position=0), "out of order|one position"), ("rows.jsonl", fields(1, fold=1), "more than one fold|fold must be"), ("rows.jsonl", lambda x: [x[0], "", *x[1:]], "rows.jsonl:2: a blank line"),
    ("links.jsonl", fields(1, adjacency_tokens="1a"), "links.jsonl:2: not as expected"), ("links.jsonl", fields(0, pair_group=5), "links.jsonl:1: not as expected"), ("links.jsonl", fields(0, status="GONE"), "links.jsonl:1: not as expected"), ("links.jsonl", fields(0, responder_chains=[["a", 1]]), "links.jsonl:1: not as expected"),
    ("links.jsonl", lambda x: [*x, x[0]], "not unique|a chain is out of order"), ("links.jsonl", lambda x: x[1:], "a proposal has no link"), ("splits.json", lambda x: ['{"k": 2,', *x[1:2], *x[1:]], "splits.json: the key 'k' occurs twice"),
]


@pytest.mark.parametrize("name,change,said", FILE_CASES)
def test_releases_that_are_refused(spark, built, tmp_path, name, change, said):
    """Exact fields and types, order and repeats, found when a release is read, whatever its checksums say."""
    with pytest.raises(ValueError, match=said):
        release.load_release(spark, rewritten(built, tmp_path, name, change))


def test_an_untouched_copy_is_read(spark, built, tmp_path):
    assert release.load_release(spark, rewritten(built, tmp_path, "rows.jsonl", lambda x: x))["rows"].count() == 24


def test_report_of_annotations(spark, built):
    out, _ = built
    table = lambda name: spark.read.parquet(str(out / "work" / name))
    text = reports.annotation_report(table("annotated"), table("links"), {"label/cs": 6, "several targets": 9, "status/ok": 6})
    assert "6 of 6 replies come within five rows, 100.0 %." in text and "- numbering_restarts: 0" in text
    assert "- label/cs: 6, expected 6: the same" in text and "- several targets: 0, expected 9: OTHER" in text
    assert reports.reach(reports.annotation_counts(table("annotated"), table("links").limit(0))).first()["share"] is None


def test_manifests_are_compared(built):
    _, found = built
    release.require_same(found, found)
    other = {**found, "files": {**found["files"], "rows.jsonl": {"sha256": "0"}, "more.jsonl": {"sha256": "0"}}, "release_fingerprint": "0"}
    assert {k: v for k, v in release.compare_manifests(found, other).items() if v != "matches"} == {"release_fingerprint": "DIFFERS", "rows.jsonl": "DIFFERS", "more.jsonl": "missing"}
    with pytest.raises(ValueError, match="more.jsonl missing, release_fingerprint DIFFERS, rows.jsonl DIFFERS"):
        release.require_same(found, other)


def test_command_line(spark, root, built, tmp_path, capsys):
    """The build by command equals the build by call; a wrong hash or another manifest ends with 1 and the reason."""
    sha = hashlib.sha256((root / "a.zip").read_bytes()).hexdigest()
    args = ["build", "--raw-root", str(root), "--archive", str(root / "a.zip"), "--version", "v1", "--counts", '{"train": 4, "val": 1, "test": 1}', "--folds", "2"]
    (tmp_path / "m.json").write_text(json.dumps(built[1]))
    done = [*args, "--sha256", sha, "--work", str(tmp_path / "w"), "--target", str(tmp_path / "v1"), "--expect", str(tmp_path / "m.json"), "--manifest", str(tmp_path / "own.json")]
    assert command.run(spark, done) == 0 and json.loads((tmp_path / "own.json").read_text()) == built[1] and capsys.readouterr().out.strip() == built[1]["release_fingerprint"]
    assert command.run(spark, [*args, "--sha256", "0" * 64, "--work", str(tmp_path / "x"), "--target", str(tmp_path / "v2")]) == 1 and "not the recorded archive" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        command.run(spark, ["build"])
