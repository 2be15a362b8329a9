"""Language-model scores by prediction by partial matching over bytes, beside a unigram base score.

The model is the trie of byte contexts of up to ORDER bytes, with counts from the training documents. A symbol's probability
starts at the longest context and escapes to the next shorter one by method C (distinct symbols over distinct symbols plus
occurrences); what a longer context has seen is excluded from the shorter ones; below order zero all symbols left are alike. A
document's score is the log10 probability of its bytes and its end, hence minus its code length.

The trie's leaves are (context, symbol) grams with counts; all shorter contexts follow from them, and everything that the
probability of a gram needs ends in the same two context bytes, but for the 65,536 counts of order one. So grams are
counted by a shuffle, dealt by those two bytes, and priced each once. Two bytes that more than GROUP_GRAMS grams end in are dealt by three; the
counts of order two of these pairs, 256 each, are sent to all. So a group has GROUP_GRAMS grams or, ending in three bytes, 65,536 at most.

Documents are gathered in blocks of about BLOCK bytes. A block asks for the words and grams that occur in it and gets their counts
and prices: neither vocabulary nor trie is ever whole in one place. What a task holds depends on BLOCK and on its longest document, which is
never cut between blocks; the rows of one word, one for each block that has it, are read by one task, which may spill them.

Defined results: a null text is empty, with the end as its only token; a null doc_id counts as the text ""; repeated rows are counted
and scored each; without training documents the base is log10(1) a token and all bytes are alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

ORDER = 4
START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
END_WORD = b" "  # a word that no text has
BLOCK, SLICE = 8 << 20, 2 << 20
GROUP_GRAMS = 250_000
FOLDS, HELD_OUT = 7, 2

STATS = "kind int, block long, payload binary, word binary, gram long, n long"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def grams_of(texts: list[bytes], order: int = ORDER) -> Iterator[np.ndarray]:
    """The keys (context bytes and symbol) of every byte and end of some texts, some texts at a time; long texts in slices."""
    run: list[bytes] = []
    size = 0
    pad = bytes([START]) * order
    for text in texts:
        data = pad + text + bytes([END])
        if len(data) > SLICE:
            for low in range(0, len(data) - order, SLICE):
                yield _keys(data[low : low + SLICE + order], order)
            continue
        run.append(data)
        size += len(data)
        if size >= SLICE:
            yield _keys(b"".join(run), order)
            run, size = [], 0
    if run:
        yield _keys(b"".join(run), order)


def _keys(data: bytes, order: int) -> np.ndarray:
    n = len(data) - order
    # eight bytes from each place on, read at once; the first order + 1 of them are the gram
    windows = np.ndarray((n,), ">u8", data + bytes(8), strides=(1,))
    key = windows.astype(np.uint64) >> np.uint64(64 - 8 * (order + 1))
    return key[(key & np.uint64(255)) != START]  # a start mark is context only


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _tally(texts: list[bytes], order: int, times: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for keys in grams_of(texts, order):
        found, n = np.unique(keys, return_counts=True)
        out.append((found, n.astype(np.int64) * times))
    return out


def _pack(ids: list, texts: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    block = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(block)
    return sink.getvalue().to_pybytes()


def _block_rows(block: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
    data = [t.encode().lower() for t in texts]
    learn = [not held_out(i) for i in ids]
    counts: Counter[bytes] = Counter()
    for own in (d.split() for d, known in zip(data, learn) if known):
        counts.update(own)
    counts[END_WORD] = sum(learn)
    for own in (d.split() for d, known in zip(data, learn) if not known):
        for word in own:
            if word not in counts:  # not a set's difference: that would walk the whole Counter for each document
                counts[word] = 0
    parts = _tally([d for d, known in zip(data, learn) if known], ORDER, 1) + _tally([d for d, known in zip(data, learn) if not known], ORDER, 0)
    grams, n = _merge(*map(np.concatenate, zip(*parts)))

    def rows(kind: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
        fields = {"kind": pa.array([kind] * size, pa.int32()), "block": pa.array([block] * size, pa.int64())}
        kinds = {"payload": pa.binary(), "word": pa.binary(), "gram": pa.int64(), "n": pa.int64()}
        fields |= {k: columns.get(k, pa.nulls(size, t)) for k, t in kinds.items()}
        return pa.RecordBatch.from_pydict(fields)

    yield rows(0, 1, payload=pa.array([_pack(ids, texts)], pa.binary()))
    words = list(counts)
    for low in range(0, len(words), 100_000):
        own = words[low : low + 100_000]
        yield rows(1, len(own), word=pa.array(own, pa.binary()), n=pa.array([counts[w] for w in own], pa.int64()))
    for low in range(0, len(grams), 100_000):
        yield rows(2, len(grams[low : low + 100_000]), gram=pa.array(grams[low : low + 100_000].view(np.int64)), n=pa.array(n[low : low + 100_000]))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc_id)
            texts.append(x.as_py())
            size += len(texts[-1])
            if size >= BLOCK:
                yield from _block_rows(number, ids, texts)
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield from _block_rows(number, ids, texts)


class _Level:
    """The counts of one order: grams seen in training, and the total and number of symbols of each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        self.at = at
        self.total = np.bincount(at, counts, len(self.contexts))
        self.symbols = np.bincount(at, minlength=len(self.contexts)).astype(float)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _look(self.keys, self.counts.astype(float), keys)

    def of(self, contexts: np.ndarray, values: np.ndarray) -> np.ndarray:
        return _look(self.contexts, values, contexts)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at the sorted keys, 0 where a wanted key is missing."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


NONE = np.empty(0, np.uint64), np.empty(0, np.int64)


def price(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER, triples: tuple[np.ndarray, np.ndarray] = NONE) -> np.ndarray:
    """log10 probability of each gram. keys: distinct, with all grams that end in the same two context bytes, three where triples has
    the two; counts: 0 for those not seen in training; pairs: the counts of order one, 256 by 256; triples: sorted grams of order two and their counts."""
    mask = lambda k: np.uint64((1 << 8 * (k + 1)) - 1)
    levels: dict[int, _Level] = {}
    seen = counts > 0
    below, n = keys[seen], counts[seen]
    for k in range(order, 1, -1):
        below, n = _merge(below & mask(k), n)
        if k == 2 and len(triples[0]):  # what is here of these is a part
            here, known = keys >> np.uint64(8) & mask(1), triples[0] >> np.uint64(8)
            own, wanted = ~np.isin(below >> np.uint64(8), known), np.isin(known, here)
            below, n = _merge(np.concatenate([below[own], triples[0][wanted]]), np.concatenate([n[own], triples[1][wanted]]))
        levels[k] = _Level(below, n)
    both = np.flatnonzero(pairs.ravel())
    levels[1] = _Level(both.astype(np.uint64), pairs.ravel()[both])
    single = pairs.sum(0)
    levels[0] = _Level(np.flatnonzero(single).astype(np.uint64), single[single > 0])
    out, todo = np.zeros(len(keys)), np.ones(len(keys), bool)
    for k in range(order, -1, -1):
        level, q = levels[k], keys & mask(k)
        total, symbols = level.of(q >> np.uint64(8), level.total), level.of(q >> np.uint64(8), level.symbols)
        if k < order:  # exclude what the next longer context has seen
            longer, context = levels[k + 1], (keys & mask(k + 1)) >> np.uint64(8)
            gone = np.bincount(longer.at, level.count(longer.keys & mask(k)), len(longer.contexts)) if len(longer.keys) else np.zeros(0)
            total, symbols = total - longer.of(context, gone), symbols - longer.of(context, longer.symbols)
        found, some = level.count(q), todo & (symbols > 0)
        hit = some & (found > 0)
        out[hit] += np.log10(found[hit] / (total[hit] + symbols[hit]))
        miss = some & ~hit
        out[miss] += np.log10(symbols[miss] / (total[miss] + symbols[miss]))
        todo &= ~hit
    left = 256 - len(levels[0].keys)
    out[todo] -= np.log10(left) if left else 0.0
    return out


def model(grams: DataFrame) -> DataFrame:
    """gram and price of each gram of grams (gram, n)."""
    counted = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams", codec="zstd")
    first = counted.groupBy(F.expr("gram & 65535").alias("pair")).agg(F.sum("n").alias("n")).collect()  # at most 65,536 rows of two numbers
    pairs = np.zeros((256, 256), np.int64)
    for row in first:
        pairs[row["pair"] >> 8, row["pair"] & 255] = row["n"]
    groups = -(-counted.count() // GROUP_GRAMS) or 1
    ends = F.expr("shiftright(gram, 8) & 65535")
    large = materialize(counted.groupBy(ends.alias("ends")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_GRAMS).select("ends"), "large")  # 65,536 rows at most
    dealt = counted.withColumn("ends", ends).join(F.broadcast(large.withColumn("is_large", F.lit(True))), "ends", "left")
    # 256 rows of two numbers for each large pair; there are fewer of those than grams are GROUP_GRAMS
    second = dealt.filter("is_large").groupBy(F.expr("gram & 16777215").alias("gram")).agg(F.sum("n").alias("n")).filter("n > 0").sort("gram").toArrow()
    triples = second.column("gram").to_numpy().astype(np.uint64), second.column("n").to_numpy().astype(np.int64)
    shared = counted.sparkSession.sparkContext.broadcast((pairs, triples))

    def priced(group: pa.Table) -> pa.Table:
        keys, n = group.column("gram").to_numpy().astype(np.uint64), group.column("n").to_numpy()
        return pa.table({"gram": group.column("gram"), "price": price(keys, n, shared.value[0], triples=shared.value[1])})

    key = F.when(F.col("is_large"), F.expr("shiftright(gram, 8) & 16777215") + (1 << 32)).otherwise(F.col("ends"))
    return dealt.select("gram", "n", F.pmod(F.xxhash64(key), F.lit(groups)).alias("part")).groupBy("part").applyInArrow(priced, "gram long, price double")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double"


def _score_block(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    rows = []
    is_word = answers.column("word").is_valid()
    own = answers.filter(is_word)
    counts = dict(zip(own.column("word").to_pylist(), own.column("value").to_numpy()))
    own = answers.filter(answers.column("gram").is_valid())
    keys, prices = own.column("gram").to_numpy().astype(np.uint64), own.column("value").to_numpy()
    order = np.argsort(keys)
    keys, prices = keys[order], prices[order]
    for payload in blocks.column("payload"):
        docs = pa.ipc.open_stream(payload.as_buffer()).read_all()
        for doc_id, x in zip(docs.column("doc_id").to_pylist(), docs.column("text")):
            data = x.as_py().encode().lower()
            words = data.split()
            words.append(END_WORD)
            known = np.fromiter(map(counts.__getitem__, words), np.float64, len(words))
            # sorted queries walk the table in order, which is several times faster
            score = sum(float(prices[np.searchsorted(keys, np.sort(found))].sum()) for found in grams_of([data]))
            rows.append((doc_id, held_out(doc_id), len(words), int(np.count_nonzero(known)), float(np.log10(known + 1).sum()), score))
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = [c.strip().split(" ")[0] for c in SCORES.split(",")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    stats = materialize(source.mapInArrow(_collect, STATS), "blocks", "kind", codec="zstd")
    of = lambda kind, *columns: stats.filter(F.col("kind") == kind).select(*columns)
    words = of(1, "block", "word", "n")
    # a word has a row for each block at most; a window reads them once, where counts and a join back would move them twice
    w = Window.partitionBy("word")
    words = words.select("block", "word", F.sum("n").over(w).alias("c"), (F.row_number().over(w.orderBy("block")) == 1).alias("first"))
    words = materialize(words, "words", codec="zstd")
    total, distinct = words.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    grams = of(2, "block", "gram", "n")
    prices = grams.select("block", "gram").join(model(grams.select("gram", "n")), "gram")
    none = lambda kind: F.lit(None).cast(kind)
    own_words = words.select(F.col("block").alias("asker"), "word", none("long").alias("gram"), F.col("c").cast("double").alias("value"))
    answers = own_words.unionByName(prices.select(F.col("block").alias("asker"), none("binary").alias("word"), "gram", F.col("price").alias("value")))
    scored = of(0, "block", "payload").groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_score_block, SCORES)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
