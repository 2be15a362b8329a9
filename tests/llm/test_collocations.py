"""op11: the phrases against brute force (odd separators, nulls, repeats, tiny sketches, many parts), and the query's rows against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from parley.llm import collocations as C

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 100 * f[p[i:j]]}
        rows = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((" ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def run(spark, docs, **options):
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string")
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "x y", "the", "\x1c", "of", "..", "c", "-", "日本", "'s"]
    gap = lambda: rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "\v", ";", ":", "!", "?"])
    made = [(rng.choice(["en", "en", "fr", None, "und", ""]), "".join(rng.choice(words) + gap() for _ in range(rng.randrange(60)))) for _ in range(n)]
    return [*made, *made[:10], ("en", None), ("fr", ""), (None, " . "), ("en", "a b " * 200), ("en", "a a a a a a a"), ("xx", "b")]


@pytest.mark.parametrize("options", [{}, {"part_bytes": 60}, {"sketch_bits": 4}, {"sketch_bits": 3, "part_bytes": 400}])
def test_same_as_brute_force(spark, options):
    """Also where most cells are shared, and where the candidates make many automata."""
    docs = texts(11)
    assert run(spark, docs, least=6, **options) == brute(docs, 6)


@pytest.mark.parametrize("options", [{"longest": 2}, {"longest": 3}, {"top": 3}])
def test_lengths_and_first_rows(spark, options):
    docs = texts(12)
    assert run(spark, docs, least=5, **options) == brute(docs, 5, **options)


def test_one_long_text_and_long_words(spark):
    """Blocks end between texts; a text of several blocks' size is read whole, and so are words of ten thousand letters."""
    word = "w" * 10_000
    docs = [("en", f"{word} {word}z, " * 700), ("en", "p q. " * 5)]
    assert run(spark, docs, least=5) == brute(docs, 5)


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2^63 from counts of 1e8 on; the arithmetic is decimal."""
    row = spark.sql("SELECT CAST(CAST(1000 * 90000000000000 AS DECIMAL(19, 0)) * CAST(900000000000000 AS DECIMAL(19, 0)) DIV (CAST(90000000000001 AS DECIMAL(19, 0)) * CAST(90000000000007 AS DECIMAL(19, 0))) AS BIGINT)").first()
    assert row[0] == 1000 * 90000000000000 * 900000000000000 // (90000000000001 * 90000000000007)


@pytest.mark.parametrize("docs", [[], [("en", None)], [("en", "one two three")]])
def test_nothing_often_enough(spark, docs):
    assert run(spark, docs, least=2) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([("en", "p q", 1, "z")] * 4, "lang string, text string, n int, phrase string")
    assert [tuple(r) for r in C.collocations(df, least=4).collect()] == [("en", 1, "p q", 4, 4, 4, 8, 2000)]


def test_query_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted, got = con.sql(C.OP11_SQL), C.op11_collocations(spark, SF)
    assert got.columns == wanted.columns and [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(map(tuple, got.collect())) == sorted(wanted.fetchall())


def test_the_texts_are_read_as_often_however_many_phrases_there_are(spark, monkeypatch):
    """No scan for each part of the phrases: as many tables and mapped reads for thousands of phrases in tiny parts as for one."""
    runs = []
    plain, own = C.materialize, type(spark.range(1))
    mapped = own.mapInArrow
    monkeypatch.setattr(C, "materialize", lambda df, *a, **k: runs.append(a) or plain(df, *a, **k))
    monkeypatch.setattr(own, "mapInArrow", lambda df, *a, **k: runs.append("read") or mapped(df, *a, **k))
    made = []
    for docs in ([("en", "p q")] * 3, texts(13)):
        runs.clear()
        found = run(spark, docs, least=3, part_bytes=60)
        made.append((len(runs), len(found)))
    assert made[0][0] == made[1][0] and made[1][1] > 100 * made[0][1]


def test_words_with_equal_hashes_are_hashed_anew(spark, monkeypatch):
    words = spark.createDataFrame([("en", "p", 4), ("en", "q", 4), ("fr", "p", 4)], "lang string, word string, n long")
    plain = C.F.xxhash64
    clash = lambda salt, *columns: C.F.lit(7).cast("long") if str(salt) == str(C.F.lit("0")) else plain(salt, *columns)
    monkeypatch.setattr(C.F, "xxhash64", clash)
    out, salt = C.hashed(words)
    assert salt == 1
    for r in out.collect():
        lexicon = C.Lexicon(r["lang"], salt)
        lexicon.read([r["word"].encode()])
        assert lexicon.hashes[1] == r["hash"] % (1 << 64)
