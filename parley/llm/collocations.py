"""Phrase collocations: phrases of two to five words that occur often, and more often than the frequencies of their parts explain.

Texts are lower-cased (A-Z), parted into pieces at punctuation and line ends, and pieces into words at spaces and tabs. Everything is counted by language.

1. Words are counted. Texts are then encoded once: each word that may reach the threshold becomes its 64-bit hash, runs of others a gap, and blocks of them are
   written as numbers. No word is parted or looked up again after that. Should two words share a hash, all are hashed anew with another salt.
2. Each gram of two words is hashed to a cell of a sketch (one row of a count-min sketch: a cell's count is an upper bound of each of its grams' counts); then,
   in a second sketch, grams of three to five words whose pairs' cells all reach the threshold. Sketches are summed by Spark as rows (cell, count), already
   summed within CELLS of them; what goes to the tasks of the next step is a bitmap of the cells that reach the threshold.
3. The grams all of whose inner grams have such cells are counted by their words' hashes, within tasks and then by bucket. The bounds are upper bounds, so no
   phrase that reaches the threshold is missed; thresholds apply to these exact counts. Words give the phrases that reach it their text.

The texts are read twice and the numbers three times, however many phrases there are. A task hands on each of its grams
once, or once in LEXICON_WORDS of them, so what is counted grows no faster than the texts; buckets grow in number with the texts, not in size. In a larger
corpus the sketches let more grams through, and results are exact all the same.

Memory: bitmaps of up to 2^SKETCH_BITS bits (64 MiB), by the amount of text; LEXICON_WORDS words; a block of BLOCK_CHARS of text, or one line; a part of
about PART_BYTES of hashes, or one block.

Defined results: null texts are empty, a null language is und; empty texts, and an empty table, give no rows; repeated rows each count; texts and words of
any length are read whole; only the columns text and lang are read; ties in rank go to the greater count, then the phrase first in UTF-8 byte order.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, skew_join, table

LEAST_COUNT, LONGEST, TOP = 100, 5, 2000
SKETCH_BITS = 29
PART_BYTES = 4 << 20
BLOCK_CHARS = 1 << 20
LEXICON_WORDS = 300_000  # whose counts a task holds before it hands them on; as many grams
CELLS = 1 << 22  # of a sketch that a task holds before it sums them
WORD_SLOTS = 15  # a bitmap's rows hold 2^15 cells

END = b"."  # stands between pieces: a full stop is never part of a word
_TABLE = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\n" * 10 + b" ")


def spaced(text: str) -> bytes:
    """The words of a text parted by spaces, with END between pieces."""
    return text.encode().lower().translate(_TABLE).replace(b"\n", b" . ")  # bytes.lower changes A-Z only


def hash_seed(lang: str, salt: int) -> int:
    """What a language's words are hashed with: xxhash64(salt, lang, word) in Spark."""
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(str(salt).encode(), 42))


class Lexicon(dict):
    """Words to ids from 1 on, in order of appearance; 0 is END. Hashes by id."""

    def __init__(self, lang: str, salt: int = 0):
        super().__init__({END: 0})
        self.seed, self.hashes = hash_seed(lang, salt), array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = out = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        return out

    def read(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of some of its lines, END between lines), in blocks of about BLOCK_CHARS."""
    for batch in batches:
        open_: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            value = spaced(text.as_py())
            open_.setdefault(lang, []).append(value)
            size[lang] = size.get(lang, 0) + len(value)
            if size[lang] >= BLOCK_CHARS:
                yield lang, b" . ".join(open_.pop(lang)).split()
                del size[lang]
        for lang, parts in open_.items():
            yield lang, b" . ".join(parts).split()


_ODD = [np.uint64((0x9E3779B97F4A7C15 + 0xD1B54A32D192ED02 * i) % (1 << 64) | 1) for i in range(8)]


def cells(sums: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The cells of grams of n words from sums of their words' hashes."""
    x = (sums ^ (sums >> np.uint64(32))) * _ODD[n % 8]
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def reaches(cells_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (cells_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Grams:
    """The grams of a part's hashes: of each length the places where all inner grams reach the threshold by the bitmaps given."""

    def __init__(self, hashes: np.ndarray, bits: int):
        self.hashes, self.bits = hashes, bits

    def longer(self, inner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cells) of grams of n words both of whose grams of n - 1 words are marked by inner."""
        at = np.flatnonzero(inner[:-1] & inner[1:])
        sums = np.zeros(len(at), np.uint64)
        for j in range(n):
            sums += self.hashes[at + j] * _ODD[j]
        return at, cells(sums, n, self.bits)

    def marks(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.hashes), bool)
        out[at] = True
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in known.items():
            counts.pop(END, None)
            words, n = pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())
            for low in range(0, len(words), 50_000):
                part = words[low : low + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, n[low : low + 50_000]], names=["lang", "word", "n"])
        known.clear()

    for lang, words in blocks(batches):
        known.setdefault(lang, Counter()).update(words)
        if sum(map(len, known.values())) > LEXICON_WORDS:
            yield from flush()
    yield from flush()


def _lexicon(known: dict[str, Lexicon], lang: str, salt: int) -> Lexicon:
    if sum(map(len, known.values())) > LEXICON_WORDS:
        known.clear()
    return known[lang] if lang in known else known.setdefault(lang, Lexicon(lang, salt))


def hashed(words: DataFrame) -> tuple[DataFrame, int]:
    """(words with hash, salt): no two words of any language share a hash, and none is 0."""
    for salt in count():
        out = words.withColumn("hash", F.xxhash64(F.lit(str(salt)), "lang", "word"))
        if not out.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 OR hash = 0").limit(1).count():
            return out, salt


def _word_cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _encode(word_map, salt: int, bits: int):
    """A row for each block: the hashes of its frequent words, with 0 first, and places in them. Other words, and those without a frequent neighbour, are gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Lexicon] = {}
        for lang, words in blocks(batches):
            lexicon = _lexicon(known, lang, salt)
            ids = lexicon.read(words)
            used = np.flatnonzero(np.bincount(ids))
            own = np.frombuffer(lexicon.hashes, np.uint64)[used]
            held = (used > 0) & reaches(word_map.value, _word_cells(own, bits))
            place = np.zeros(len(lexicon.hashes), np.uint32)
            place[used[held]] = np.arange(1, held.sum() + 1)
            at = np.concatenate([[0], place[ids], [0]]).astype(np.uint32)
            beside = np.zeros(len(at), bool)
            beside[1:-1] = (at[1:-1] > 0) & ((at[:-2] > 0) | (at[2:] > 0))
            at[~beside] = 0
            at = at[1:][beside[1:] | beside[:-1]]  # one gap after each run
            if len(at):
                hashes = np.concatenate([np.zeros(1, np.uint64), own[held]])
                yield pa.RecordBatch.from_arrays([pa.array([hashes.tobytes()]), pa.array([at.tobytes()])], names=["hashes", "places"])

    return run


def _parts(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[np.ndarray]:
    """The hashes of blocks, gaps as 0, some blocks at a time; a gap ends each block."""
    held, size = [], 0
    for batch in batches:
        for hashes, places in zip(batch.column("hashes"), batch.column("places")):
            held.append(np.frombuffer(hashes.as_buffer(), np.uint64)[np.frombuffer(places.as_buffer(), np.uint32)])
            size += held[-1].nbytes
            if size >= part_bytes:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _sketch(pair_map, longest: int, bits: int, part_bytes: int):
    """Cells of pairs, or, given the pairs' bitmap, of longer grams of frequent pairs; counts summed within CELLS of them."""

    def summed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(found), return_counts=True)
        for low in range(0, len(cell), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(cell[low : low + 100_000]), pa.array(n[low : low + 100_000])], names=["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for hashes in _parts(batches, part_bytes):
            grams, inner = Grams(hashes, bits), hashes > 0
            for n in range(2, longest + 1):
                at, cell = grams.longer(inner, n)
                if n == 2 and pair_map:
                    at = at[reaches(pair_map.value, cell)]
                else:
                    found.append(cell.astype(np.int32))
                inner = grams.marks(at)
            if sum(map(len, found)) >= CELLS:
                yield from summed(found)
                found = []
        if found:
            yield from summed(found)

    return run


def _names(longest: int) -> list[str]:
    return [f"w{j}" for j in range(longest)]


def _count_grams(maps: list, longest: int, bits: int, part_bytes: int, buckets: int):
    """The grams all of whose cells reach the threshold, as their words' hashes (0 beyond the last), and how often a task has them: a row for each bucket of grams."""

    def rows(held: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        grams, n = np.frombuffer(b"".join(held), np.uint64).reshape(-1, longest), np.fromiter(held.values(), np.int64)
        bucket = sum((grams[:, j] * _ODD[j] for j in range(longest)), np.zeros(len(n), np.uint64)) >> np.uint64(32)
        bucket %= np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        grams, n, bucket = grams[order], n[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
        ends = [*starts[1:], len(n)]
        packed = [[x[i:j].tobytes() for i, j in zip(starts, ends)] for x in (grams, n)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), *[pa.array(x, pa.binary()) for x in packed]], names=["bucket", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for hashes in _parts(batches, part_bytes):
            grams, inner = Grams(hashes, bits), hashes > 0
            names = np.unique(hashes, return_inverse=True)[1]
            for n in range(2, longest + 1):
                at, cell = grams.longer(inner, n)
                at = at[reaches(maps[n > 2].value, cell)]
                # grams are told apart by the numbers of both their inner grams, so equal numbers are equal words
                _, first, number, times = np.unique(names[at] << 32 | names[at + 1], return_index=True, return_inverse=True, return_counts=True)
                keys = np.zeros((len(first), longest), np.uint64)
                for j in range(n):
                    keys[:, j] = hashes[at[first] + j]
                for key, k in zip(keys.view(f"V{8 * longest}").ravel().tolist(), times.tolist()):
                    held[key] = held.get(key, 0) + k
                inner, names = grams.marks(at), np.zeros(len(inner), np.int64)
                names[at] = number
            if len(held) > LEXICON_WORDS:
                yield from rows(held)
                held = {}
        if held:
            yield from rows(held)

    return run


def _summed(longest: int, least: int):
    """The grams of a bucket that occur at least so often in all tasks."""

    def run(group: pa.Table) -> pa.Table:
        grams, n = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in group.column(c)]) for c in ("grams", "counts"))
        grams = grams.reshape(-1, longest)
        order = np.lexsort(grams.T)
        grams, n = grams[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)]))
        total = np.add.reduceat(n, starts)
        held = total >= max(1, least)
        return pa.table([*[pa.array(grams[starts[held], j]) for j in range(longest)], pa.array(total[held])], names=[*_names(longest), "n"])

    return run


def bitmap(reached: DataFrame, bits: int) -> np.ndarray:
    """The cells of reached as a bitmap: at most 2^(bits - 15) rows of 4 KiB come to the driver, 64 MiB in all."""
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    rows = reached.groupBy(F.shiftright("cell", WORD_SLOTS).alias("slot")).agg(F.bitmap_construct_agg(F.col("cell") % (1 << WORD_SLOTS)).alias("map"))
    for row in rows.toLocalIterator():
        at = row["slot"] << (WORD_SLOTS - 3)
        part = np.frombuffer(row["map"], np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, sketch_bits: int = SKETCH_BITS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, phrase and n. All words, and the phrases of two to longest words that occur at least so often."""
    spark = docs.sparkSession
    # no phrase passes a line end, so lines go to the workers one by one, which keeps batches of rows small
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(sketch_bits, max(16, math.ceil(math.log2(size / 8 + 1))))
    share = spark.sparkContext.broadcast
    words = materialize(texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    known, salt = hashed(words)
    known = known.filter(F.col("n") >= least).select("hash", "lang", "word")
    word_map = share(bitmap(known.select(F.shiftrightunsigned("hash", 64 - bits).alias("cell")), bits))
    encoded = materialize(texts.mapInArrow(_encode(word_map, salt, bits), "hashes binary, places binary"), "encoded", codec="zstd")
    maps = []
    for to in dict.fromkeys((2, longest)):
        summed = encoded.mapInArrow(_sketch(maps[0] if maps else None, to, bits, part_bytes), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        maps.append(share(bitmap(summed.filter(F.col("n") >= least).select("cell"), bits)))
    columns = _names(longest)
    counts = encoded.mapInArrow(_count_grams(maps, longest, bits, part_bytes, max(1, size // part_bytes)), "bucket long, grams binary, counts binary")
    grams = materialize(counts.groupBy("bucket").applyInArrow(_summed(longest, least), ", ".join(f"{c} long" for c in [*columns, "n"])), "grams")
    # each word of a frequent phrase is frequent
    each = skew_join(grams.select("*", F.posexplode(F.array(*columns)).alias("i", "hash")).filter("hash <> 0"), known, ["hash"], "inner")
    named = each.groupBy(*columns, "n").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    phrases = materialize(named.select("lang", F.array_join("w.word", " ").alias("phrase"), "n"), "phrases")
    for m in (word_map, *maps):
        m.unpersist()
    return words.select("lang", F.col("word").alias("phrase"), "n"), phrases


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP, sketch_bits: int = SKETCH_BITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    a: the phrase's count, n: the language's words, l and r: counts of the two sides of the cut that gives the lowest score, floor(1000 a n / (l r)). Phrases
    inside a longer one that occurs as often are left out.
    """
    words, phrases = phrase_counts(docs, least, longest, sketch_bits, part_bytes)
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"))
    if totals.count() <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    frequent = words.filter(F.col("n") >= least).unionByName(phrases)
    own = phrases.withColumn("w", F.split("phrase", " "))
    run = lambda low, n: F.array_join(F.slice("w", low, n), " ")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.size("w") - 1, F.lit(2))), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda low: run(low, n))))
    covered = own.filter(F.size("w") > 2).select("lang", F.explode(inside).alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = own.join(covered, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < n")
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), run(F.lit(1), k).alias("first"), run(k + 1, F.size("w") - k).alias("rest")))).alias("cut"))
    side = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))  # noqa: E731  each part of a frequent phrase is frequent
    cuts = cuts.select("lang", "phrase", "a", "cut.*").join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = "CAST(1000 * a AS DECIMAL(19, 0)) * CAST(words AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    scored = cuts.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, w, len(w) AS m, unnest(range(1, 6)) AS k FROM w),
o AS (SELECT lang, k, unnest(list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM g WHERE k <= m),
f AS (SELECT lang, k, phrase, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 100),
s AS (SELECT lang, a, k, w, unnest(range(2, k)) AS z FROM c),
v AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(range(1, k - z + 2), lambda i: array_to_string(w[i:i + z - 1], ' '))) AS phrase FROM s) GROUP BY ALL),
e AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c LEFT JOIN v USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
x AS (SELECT e.lang, e.phrase, a, cut, l.n AS l, r.n AS r, t.n AS n, ((1000::HUGEINT * a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM e JOIN t USING (lang)
 JOIN f l ON l.lang = e.lang AND l.k = cut AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = e.lang AND r.k = e.k - cut AND r.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000"""
