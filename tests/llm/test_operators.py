"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import bpe, common, components, exact_dedup, lm_score, minhash, packing, pii, quality_classifier, quality_rules, simhash, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string, bin string"


def make(spark, rows):
    """rows of (doc_id, text); further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "été", "Ünd", "the", "of", "a", "漢字", "it's", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "\n")) for i in range(10)] + [(120, rows[3][1] + "  "), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "alone"), (None, None), (300, " ".join(rng.choice(words) for _ in range(60_000)))]
    near = rows[59][1].split() * 6
    rows += [(400 + i, " ".join(near[:i] + ["changed"] + near[i + 1 :])) for i in range(5)]
    return rows


def test_exact_dedup(spark, corpus):
    got = exact_dedup.exact_dedup(make(spark, corpus)).collect()
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in corpus:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(corpus)
    by_sha = {hashlib.sha256(b.encode()).hexdigest(): g for b, g in groups.items()}
    kept = Counter()
    for r in got:
        g = by_sha[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (len(g), min(g)[3])
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == min(g)[3]
    assert set(kept.values()) == {1} and kept.keys() == by_sha.keys()


def test_tables_can_be_removed(spark):
    df = common.materialize(spark.range(3), "range")
    assert df.count() == 3 and common.remove_tables(spark) >= 1
    assert common.remove_tables(spark) == 0


def test_chunks_are_content_defined_and_verified(spark, monkeypatch):
    rng = np.random.default_rng(1)
    tail = rng.bytes(60_000)

    def ends(data):
        cuts = exact_dedup.cuts(len(data), [int(x) for x in exact_dedup.candidates(data) if x >= 32])
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    one, two = ends(rng.bytes(5_000) + tail), ends(rng.bytes(7_000) + tail)
    assert len(set(one) & set(two)) > 0.8 * len(ends(tail)) and all(len(c) <= exact_dedup.MAX_CHUNK for c in one)
    whole = exact_dedup.candidates(tail)
    monkeypatch.setattr(exact_dedup, "SEGMENT", 1000)
    assert (exact_dedup.candidates(tail) == whole).all()


def test_simhash(spark, corpus):
    def brute(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        n = max(1, len(words) - 3)
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(n)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)

    prints = [brute(t) for _, t in corpus]
    root = list(range(len(corpus)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(corpus)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(corpus):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    wanted = Counter((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(corpus))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_dedup(make(spark, corpus)).collect()) == wanted


@pytest.mark.parametrize("large", [4096, 1])
def test_links_connect_what_is_linked(spark, large):
    rng = random.Random(3)
    values = {0}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    root = {v: v for v in values}
    for r in components.connected_components(simhash.links(df, len(values), large)).collect():
        root[r["node"]] = r["root"]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert root == {v: find(v) for v in values}


def test_block_keys_cover_all_close_pairs():
    for n in (10, 10**6, 10**9):
        blocks = simhash.block_count(n)
        assert blocks > simhash.DISTANCE


def test_pii_spans():
    def brute(t):
        digits = lambda x: re.sub("[^0-9]", "", x)
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]

    rng = random.Random(1)
    for _ in range(30_000):
        t = "".join(rng.choice("a1@.+ -(2é9") for _ in range(rng.randint(0, 40)))
        assert pii.find_plain(t) == brute(t)
    assert pii.find_plain("4" * 200_000 + "@" * 1000 + "." * 1000) == []


DISGUISES = [
    ("mail john [at] example [dot] com please", "email", "john [at] example [dot] com"), ("anna(at)mail.example.com", "email", "anna(at)mail.example.com"), ("é jane at example dot co dot uk ok", "email", "jane at example dot co dot uk"),
    ("j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"), ("call five five five one two three four five six seven now", "phone", "five five five one two three four five six seven"),
    ("plus one two oh two five five five one two three four", "phone", "plus one two oh two five five five one two three four"), ("ip 192 dot 168 dot 1 dot 1", "ip", "192 dot 168 dot 1 dot 1"), ("jo\u200bhn@example.com x", "email", "jo\u200bhn@example.com"),
]


@pytest.mark.parametrize("text,kind,span", DISGUISES)
def test_pii_disguises(text, kind, span):
    plain = pii.find_plain(text)
    found = pii.find_disguised(text, plain)
    assert (kind, span) in [(k, text[s:e]) for k, s, e in plain + found] or any(span.endswith(text[s:e]) for _, s, e in plain)
    assert f"[{kind.upper()}]" in pii.redact_text(text)


@pytest.mark.parametrize("text", ["he looked at polka dot dresses", "one two three go", "meet at noon", "", "the a at b dot"])
def test_pii_leaves_prose(text):
    assert pii.redact_text(text) == text


def test_pii_tables(spark, corpus):
    df = make(spark, [*corpus, (900, "x a@b.co y")])
    assert pii.detect(df).count() == len(corpus) + 1
    out = pii.redact(df)
    assert out.columns == df.columns
    row = out.filter("doc_id = 900").first()
    assert (row["text"], row["n_chars"]) == ("x [EMAIL] y", 11)
    assert out.filter("text IS NULL").count() == sum(t is None for _, t in corpus)


def test_url_filter(spark):
    urls = ["http://com/", "https://WWW.Example.com/en/a?x#y", "http://example.com/en/", "http://example.com/en", "http://a.net/es/1", "http://net/es/", "http://anet/es/", "http://x.com", "no scheme", None, "http://y.org/#a", "a://b://c/d", "http://m.net/fr/x/en/", ""]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (raw.lower() == h or raw.lower().endswith("." + h)) and path.startswith(p)]
        return (raw.lower(), path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    for bound in (url_filter.BROADCAST_BYTES, 0):  # the trie, then the join for lists of any size
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, broadcast_bytes=bound).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}
    trie = url_filter.Trie([("block", "a.b", "/x"), ("allow", "b", "/xy/"), ("block", "", "/q")])
    assert trie.match("a.b", "/xyz")[4] == "a.b/x" and trie.match("c.b", "/xy/1")[4] == "b/xy/" and trie.match("z", "/qq")[4] == "/q" and trie.match("c.b", "/x") is None


@pytest.mark.parametrize("most", [lm_score.GROUP_GRAMS, 3])
def test_lm_scores(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(lm_score, "GROUP_GRAMS", most)
    got = lm_score.lm_scores(make(spark, corpus)).collect()
    data = [(i, (t or "").encode().lower()) for i, t in corpus]
    known = [d for i, d in data if not lm_score.held_out(i)]
    counts = Counter(w for d in known for w in [*d.split(), None])
    total, distinct = sum(counts.values()), len(counts)
    context = {k: {} for k in range(lm_score.ORDER + 1)}
    for d in known:
        s = bytes([lm_score.START]) * lm_score.ORDER + d + bytes([lm_score.END])
        for j in range(lm_score.ORDER, len(s)):
            for k in context:
                context[k].setdefault(s[j - k : j], Counter())[s[j]] += 1

    def price(before, symbol):
        out, gone = 0.0, set()
        for k in range(lm_score.ORDER, -1, -1):
            left = {s: n for s, n in context[k].get(before[len(before) - k :], {}).items() if s not in gone}
            if left:
                t = sum(left.values()) + len(left)
                if symbol in left:
                    return out + np.log10(left[symbol] / t)
                out += np.log10(len(left) / t)
            gone |= set(left)
        return out - np.log10(256 - len(gone))

    wanted = []
    for i, d in data:
        words = [*d.split(), None]
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        s = bytes([lm_score.START]) * lm_score.ORDER + d + bytes([lm_score.END])
        score = sum(price(s[j - lm_score.ORDER : j], s[j]) for j in range(lm_score.ORDER, len(s))) if len(d) < 5000 else None
        wanted.append((str(i), lm_score.held_out(i), len(words), sum(counts[w] > 0 for w in words), total, base, score))
    key = lambda r: (r[0], r[2], r[5])
    for g, w in zip(sorted([(str(r["doc_id"]), *r[1:]) for r in got], key=key), sorted(wanted, key=key)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and (w[6] is None or g[6] == pytest.approx(w[6]))


ODD = "aaabAÉéΣσİıß漢字 \n\t\x1c  'sre12³½<|>endoftext—…🙂\u0301\u0307.!!thethingsing"


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["x<|endoftext|>y", "<|startoftext|>'s", "", "aaaaaaaaa " * 9, "a" * 3000]


def test_tokens_as_the_library(monkeypatch):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own, texts = packing.Tokens(bpe.read_text(P.path("byte_bpe_50k.json"))), odd_texts(4000)
    for segment in (1 << 20, 7):
        monkeypatch.setattr(packing, "SEGMENT_CHARS", segment)
        assert [np.frombuffer(own.encode(x), "<u4").tolist() for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("pieces", [packing.PARTITION_PIECES, 16])
def test_packing(spark, corpus, pieces):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    parts = packing.pieces(make(spark, corpus), P.path("byte_bpe_50k.json"), capacity=256)
    got = packing.pack(parts, capacity=256, partition_pieces=pieces).collect()
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    wanted = Counter()
    for i, text in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 256 or 256
        for n, low in enumerate([0, *range(first, len(ids), 256)]):
            piece = ids[low : first if not n else low + 256]
            wanted[i, n, low, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == wanted
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    bound = packing.lower_bound(np.array([r["length"] for r in got]), 256)
    short = [r["length"] for r in got if r["length"] < 256]
    alone = len(packing.best_fit(short, 256)[2]) + len(got) - len(short)  # best-fit decreasing over all pieces at once
    assert bound <= len(bins) <= alone + (pieces == 16)
    assert all((r["bins"] is None) == (r["length"] == 256) and (r["bins"] is None or r["bins"] >= r["bound"]) for r in got)


def test_partitions_stay_bounded(spark, monkeypatch):
    """Sizes that leave a gap to the bound everywhere, so that all partitions give back what they may."""
    seen, write = [], packing.materialize

    def watched(df, name):
        out = write(df, name)
        if name == "packed":
            seen.append(max(r["count"] for r in out.groupBy("part").count().collect()))
        return out

    monkeypatch.setattr(packing, "materialize", watched)
    rng = np.random.default_rng(7)
    sizes = rng.integers(700, 1100, 20_000).tolist()
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECE)
    got = packing.pack(df, partition_pieces=400).select("sequence_id", "length").collect()
    assert sorted(r["length"] for r in got) == sorted(sizes) and len(seen) > 1 and max(seen) < 600
    held = Counter()
    for r in got:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= packing.CAPACITY and len(held) <= 1.01 * len(packing.best_fit(sizes)[2])


@pytest.mark.parametrize("low, high, n, pieces, over", [(1, 2047, 1000, packing.PARTITION_PIECES, 0), (1, 2047, 1000, 150, 12), (1, 400, 3000, 400, 1), (1, 700, 3000, 100, 1), (300, 900, 2000, 300, 2)])
def test_sequences_against_packing_all_at_once(spark, low, high, n, pieces, over):
    """One partition is packed as a whole; many partitions, which exchange, need at most so many sequences more."""
    sizes = np.random.default_rng(3).integers(low, high + 1, n).tolist()
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECE)
    used = packing.pack(df, partition_pieces=pieces).select("sequence_id").distinct().count()
    alone, bound = len(packing.best_fit(sizes)[2]), packing.lower_bound(np.array(sizes))
    print(low, high, pieces, used, alone, bound)
    assert bound <= used <= alone + over


def test_other_files_go_to_the_library():
    import json

    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    spec = json.loads(bpe.read_text(P.path("byte_bpe_50k.json")))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        text = json.dumps(spec | change)
        own, t = packing.Tokens(text), tokenizers.Tokenizer.from_str(text)
        assert own.ranked is None and np.frombuffer(own.encode("Hello THE world"), "<u4").tolist() == t.encode("Hello THE world", add_special_tokens=False).ids


def test_lower_bound_is_one():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 25))]
        bins = len(packing.best_fit(sizes, 20)[2])
        assert max([0, -(-sum(sizes) // 20), sum(s > 10 for s in sizes)]) <= packing.lower_bound(np.array(sizes, int), 20) <= bins


def test_quality_classifier_on_held_out_documents(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        text = [w + "##" if kind == 1 else "awful" if kind == 0 and rng.random() < 0.05 else w for w in text]
        rows.append((i, " ".join(text + ["awful"] * (kind == 0))))
        if i < 300:
            labels.append((i, int(kind != 1), int(kind == 0)))
    docs = make(spark, [*rows, (700, None), (701, "")])
    model = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, model).collect()}
    right = [got[i]["kept"] == (i % 3 == 2) for i in range(300, 600)]
    assert sum(right) >= 0.95 * len(right) and got[700]["score"] == got[701]["score"] == 0
    assert all(0 <= r["expected_grade"] <= 2 for r in got.values())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, quality_classifier.train(docs, none)).count() == len(rows) + 2


@pytest.mark.parametrize("name", ["exact", "simhash", "pii", "lm", "quality", "packing", "warc"])
def test_empty_tables(spark, name, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    docs = make(spark, [])
    if name == "warc":
        pages = spark.createDataFrame([], "page_id long, url string, html string")
        warc.write_archives(pages, str(tmp_path / "w"))
        assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0
        return
    run = {"exact": exact_dedup.exact_dedup, "simhash": simhash.simhash_dedup, "pii": pii.redact, "lm": lm_score.lm_scores, "quality": quality_rules.quality_rules, "packing": lambda d: packing.pack(packing.pieces(d, P.path("byte_bpe_50k.json")))}
    assert run[name](docs).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = lambda n=120: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text()) for i in range(40)]
    rows += [(50, rows[0][1]), (51, rows[1][1].replace(" ", "\n")), (0, rows[0][1]), (60, "short"), (61, None), (62, rows[2][1] + " mail a@b.co")]
    docs = make(spark, rows)
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        kept.write.parquet(str(tmp_path / name.replace(" ", "-")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len(ids) == len(set(ids)) and set(range(3, 40)) <= set(ids) and not {50, 60, 61} & set(ids)
    assert kept.filter("text LIKE '%a@b.co%'").count() == 0
    assert pipeline.STAGES[-1][1](spark, kept, "").select("doc_id").distinct().count() == len(ids)


def test_near_stage_keeps_unrelated_texts_of_one_doc_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(10)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80))
    rows = [(None, text()) for _ in range(4)] + [(5, text()), (5, text()), (6, text())]
    rows += [(7, rows[-1][1])]
    got = pipeline.near(spark, make(spark, rows), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows[:-1])


def test_near_stage_links_similarity_of_four_fifths(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = list(corpus)
    for k in range(60):  # each changed word takes five of 200 shingles
        base = [word() for _ in range(204)]
        rows.append((1000 + 10 * k, " ".join(base)))
        for c in range(1, 4):
            places = rng.sample(range(5, 200, 8), 2 * c)
            rows.append((1000 + 10 * k + c, " ".join(word() if i in places else w for i, w in enumerate(base))))

    def shingles(t):
        words = (t or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
                linked += 1
    assert linked > 150
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (doc is None, doc or 0))
    got = pipeline.near(spark, make(spark, rows), "").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(None if none else doc for none, doc in least.values())


def template_pages(n, rng):
    """n sets of 500 shingles of a template and 60 to 80 own ones: similar by less than 0.8 but for the few with least own ones."""
    template = np.arange(500, dtype=np.uint64)
    return {i: np.concatenate([template, np.arange(10**6 + 1000 * i, 10**6 + 1000 * i + rng.randint(60, 80), dtype=np.uint64)]) for i in range(n)}


def test_near_stage_pairs_of_template_pages_do_not_grow_with_the_square(spark):
    met = []
    for n in (60, 120):
        sets = template_pages(n, random.Random(13))
        members = [(i, len(x), i if len(x) > 562 else -1) for i, x in sets.items()]  # up to 562 and 562 are linked
        classes = spark.createDataFrame(members, "fp long, n long, root long")
        table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "fp long, shingles binary")
        small, large = minhash._sides(minhash._prefixes(classes, table))
        keys = ["shingle", "size"]
        met.append(small.select(*keys, "root").distinct().join(large.select(*keys, F.col("root").alias("other")).distinct(), keys).filter("root <> other").count())
    assert met[1] <= 2.5 * met[0] + 100, met


def test_near_links_of_sets_of_all_sizes(spark):
    """One bucket of sets that share a template, parts of each other or nothing; components as those of all pairs."""
    rng = random.Random(14)
    sets = template_pages(40, rng)
    for i in range(40, 120):
        base = sets[rng.randrange(i)]
        kept = base[[rng.random() < rng.choice([0.85, 0.92, 0.99]) for _ in base]]
        sets[i] = np.unique(np.concatenate([kept, np.arange(10**7 + 1000 * i, 10**7 + 1000 * i + rng.randint(0, len(base) // 4), dtype=np.uint64)]))
    sets |= {200 + i: np.arange(5 * 10**8 + 3 * i, 5 * 10**8 + 3 * i + rng.randint(1, 9), dtype=np.uint64) for i in range(40)}
    sets = {i: x for i, x in sets.items() if len(x)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and minhash.similar(sets[i], sets[j]):
                root[find(j)] = find(i)
    wanted = {i: find(i) for i in sets}
    members = spark.createDataFrame([(0, 7, i, len(x), len(sets)) for i, x in sets.items()], "t int, key long, fp long, n long, k long")
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "fp long, shingles binary")
    found = {r["node"]: r["root"] for r in components.connected_components(minhash.links(members, table)).collect()}
    got = {}
    for i in sets:
        got.setdefault(found.get(i, i), set()).add(i)
    same = {}
    for i in sets:
        same.setdefault(wanted[i], set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same.values()))
    assert len(same) > 20 and max(map(len, same.values())) > 10


def test_near_pairs_across_components_are_compared(spark):
    """A chain in one bucket: neither the least nor the greatest class is similar to all."""
    sets = {i: np.arange(10 * i, 10 * i + 100, dtype=np.uint64) for i in range(12)}
    members = spark.createDataFrame([(0, 7, i, 100, 12) for i in sets], "t int, key long, fp long, n long, k long")
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "fp long, shingles binary")
    found = {r["node"]: r["root"] for r in components.connected_components(minhash.links(members, table)).collect()}
    assert found == dict.fromkeys(range(1, 12), 0)


def test_near_pairs_without_a_common_band_are_linked(spark):
    """Four of five shingles in common and none of 64 bands: found by trying some two million last words."""
    one = "one two three four five six seven eight"
    two = one + " w17x49723"
    sets = [minhash.shingle_set(x) for x in (one, two)]
    assert minhash.similar(*sets) and not (minhash.band_keys(sets[0]) == minhash.band_keys(sets[1])).any()
    found = {r["doc_id"]: r["root"] for r in minhash.near_duplicates(make(spark, [(1, one), (2, two), (3, "other words"), (4, "")])).collect()}
    assert found[1] == found[2] and len(set(found.values())) == 3


def test_near_similar_sets_share_a_head():
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(20_000):
        n, dropped, added = rng.integers(1, 90), rng.integers(0, 6), rng.integers(0, 6)
        base = rng.integers(0, 1 << 63, n + added, dtype=np.uint64)
        one, two = np.unique(base[:n]), np.unique(base[min(dropped, n) :])
        if len(two) and minhash.similar(one, two):
            seen += 1
            both = np.intersect1d(minhash.heads(one), minhash.heads(two)).size
            assert both >= max(minhash.in_common(len(one)), minhash.in_common(len(two)))
        assert len(minhash.heads(one)) == len(one) - -(-4 * len(one) // 5) + len(one) // 20 + 1
    assert seen > 3000 and not len(minhash.heads(np.empty(0, np.uint64)))


FRAGMENTS = ["jane.d\u043ee@example.com", "john.smith@mail.ex\u0430mple.com", "jo\u200bhn@example.com", "j\u043ehn@example.com"]


@pytest.mark.parametrize("address", FRAGMENTS)
def test_pii_disguised_spans_are_whole(address):
    text = f"mail {address} now"
    plain = pii.find_plain(text)
    assert plain and ("email", address) in [(k, text[s:e]) for k, s, e in pii.find_disguised(text, plain)]
    assert pii.redact_text(text) == "mail [EMAIL] now"


def test_pii_disguised_spans_repeat_no_plain_span():
    text = "a@b.co, j\u043ehn [at] c [dot] org, +1 555 123 4567"
    plain = pii.find_plain(text)
    assert pii.find_disguised(text, plain) == [("email", 8, 29)] and len(plain) == 2


ALONE = ["john at example.com", "john at example dot co", "john at example dot xyz", "john at example dot ai", "john@example dot za", "+5 5 5 1 two 3 4 5"]
ALONE += [f"john{at}example.com" for at in ("{@}", "<@>", "[ @ ]", "( at }", "<at >", "[at]", "(AT)")] + [f"john@example{dot}com" for dot in ("{.}", "<.>", "[ . ]", "<dot >", "( dot }", "[DOT]")]


@pytest.mark.parametrize("text", ALONE)
def test_pii_each_disguise_alone(text):
    assert pii.redact_text(f"write: {text}") in ("write: [EMAIL]", "write: [PHONE]")


def test_pii_query_returns_the_columns_of_the_contract(spark, tmp_path):
    rows = [(1, "mail a@b.co or 10.0.0.300 or 10.0.0.1"), (2, None), (3, ""), (4, "call +49 30 1234567, ann at host dot com"), (4, "call +49 30 1234567, ann at host dot com"), (None, "4111 1111 1111 1111 \u6f22 x@y.z")]
    make(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and pii.luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.sub("[^0-9]", "", x)) <= 15),
    }
    wanted = Counter()
    for doc, text in rows:
        base = [(kind, m.start(), m.end()) for kind, (pattern, holds) in patterns.items() for m in re.finditer(pattern, text or "") if holds(m[0])]
        added = [("email", 21, 40)] if doc == 4 else []
        join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), x[1])))
        wanted[(doc, *[sum(k == kind for k, _, _ in base) for kind in patterns], hashlib.sha256(join(base).encode()).hexdigest(), join(base + added))] += 1
    out = pii.op3_pii(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert Counter(map(tuple, out.collect())) == wanted


def test_pii_evidence_is_in_whatever_the_patterns_match():
    rng = random.Random(11)
    units = [*pii.DIGIT_WORDS, *pii.REPEATS, "plus", "4", "7", "55", "phone", "someone", "Nine", "ONE", "\u017fix", "\u0130", "n\u0131ne", "_one", "dot", "at", "com", "ann", ".com", ".io", "@", "x.de"]
    seen = 0
    for _ in range(30_000):
        text = "".join(rng.choice(units) + rng.choice([" ", " ", "  ", "-", ", ", "", "."]) for _ in range(rng.randint(1, 7)))
        low, odd = text.lower(), any(c in text for c in pii._CASE_ODD)
        if any(pii._DIGIT_WORD.search(m[0]) for m in pii._SPELLED.finditer(text)):
            seen += 1
            assert odd or pii._spelled_evidence(low), text
        if (" at " in low or " dot " in low) and pii._SAID.search(text):
            seen += 1
            assert odd or " dot " in low or pii._ENDING.search(low), text
    assert seen > 1000


def test_pii_tapes_map_back():
    rng = random.Random(13)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "\u200b", "one ", "two ", "three ", " at ", " dot ", "com", "[at]", "(dot)", "\u0430", "\U0001d7d0", "1", "@"]) for _ in range(rng.randint(0, 25)))
        tape = pii.Tape(text)
        want = [(c, i, i + 1) for i, c in enumerate(text)]
        for pattern, output in ((pii._UNSEEN, lambda m: ""), (pii._SPELLED, pii._digits), (pii._AT, lambda m: "@"), (re.compile("a+"), lambda m: "xyz"), (re.compile("y"), lambda m: "")):
            now, last = "".join(c for c, _, _ in want), 0
            new = []
            for m in pattern.finditer(now):
                if output(m) != m[0]:
                    new += want[last : m.start()] + [(c, want[m.start()][1], want[m.end() - 1][2]) for c in output(m)]
                    last = m.end()
            want, tape = new + want[last:], tape.rewrite(pattern, output)
            assert tape.text == "".join(c for c, _, _ in want)
            assert [tape.source(i, i + 1) for i in range(len(want))] == [(s, e) for _, s, e in want]


LONG = [" " * 10**6, "john at example dot com" + " " * 10**6 + "x", "a at " * 200_000, "a@b dot " * 125_000, "one" + " ," * 500_000, "1 " * 500_000 + "a", "+1" + "-" * 10**6, "one two three " * 70_000, "\u0430\u200b" * 500_000, "a." * 500_000 + "@", "a@a." * 250_000, "[at] " * 200_000, "j\u043ehn [at] c [dot] org, " * 38_000, "1" * 10**6]


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
def test_pii_takes_linear_time(text):
    import time

    def took(t):
        begun = time.process_time()
        pii.redact_text(t)
        return time.process_time() - begun

    assert took(text) < 12 * took(text[: len(text) // 4]) + 1.5
