"""SimHash near-deduplication with pigeonhole blocks.

A fingerprint has a bit set where over half of the document's shingle hashes have it. Fingerprints link when
they differ in at most DISTANCE bits. With n > DISTANCE blocks, such a pair agrees on at least n - DISTANCE whole blocks,
so it shares the key of one of the C(n, n - DISTANCE) choices of blocks; each choice is one join table. Distinct
fingerprints are joined on these keys and each candidate pair's Hamming distance is verified.

A bucket yields a spanning forest of its verified links, never its pairs. Buckets beyond LARGE_BUCKET members, where
comparing members is dearer than enumerating neighbours, meet in the middle instead: two fingerprints are within four
bits exactly when some value is within two bits of both. That is exact and linear in the bucket.

Defined results: null and empty texts (and those of white space) have no shingle and fingerprint zero, linked like any
other; equal fingerprints are one class; repeated rows each get their own row; texts of any length are read whole, in blocks of shingles; an
empty table gives an empty table; other columns are ignored. A component whose doc_ids are all null has none either.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_join, table, text_or_empty
from .components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
LARGE_BUCKET = 4096
BLOCK = 1 << 16  # shingles counted at once


def fingerprint(text: str) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = text.encode().lower().split()  # on bytes both look at ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    span = min(SHINGLE, len(words))
    n = len(words) - span + 1
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for low in range(0, n, BLOCK):
        high = min(n, low + BLOCK)
        packed = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts[low:high], starts[low + span : high + span])])
        bits = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(values)], names=["doc_id", "content", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, content (xxhash64 of the text), fp (signed long)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), text_or_empty().alias("text"))
    return source.mapInArrow(_fingerprints, "doc_id long, content long, fp long")


def block_count(n: int) -> int:
    """The fewest blocks for which chance alone puts under one of n fingerprints into a bucket: 6 (15 keys each) at first, 9 (126 keys) from 3e8 on."""
    return next((b for b in range(DISTANCE + 2, 9) if n < 2 ** (64 * (b - DISTANCE) // b)), 9)


def block_keys(fp: Column, blocks: int) -> Column:
    """An array of (table, key), one for each choice of blocks - DISTANCE blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(sum(choice)))).alias("key")) for i, choice in enumerate(combinations(masks, blocks - DISTANCE))])


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct signed fingerprints."""
    out = []
    if len(values) <= 8:
        group = values.tolist()
        left = set(range(1, len(group)))
        todo = [0]
        while todo or left:
            i = todo.pop() if todo else left.pop()
            near = [j for j in left if ((group[i] ^ group[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance]
            left.difference_update(near)
            todo += near
            out += [(group[i], group[j]) for j in near]
        return out
    rest = values
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                todo += list(found)
                out += [(int(x), y) for y in found.tolist()]
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("members")
        values, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        links = [x for low, high in zip(ends, ends[1:]) for x in forest(values[low:high])]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def _near_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values within half the distance, with the fingerprint."""
    one = [1 << i for i in range(64)]
    flips = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], np.uint64)
    for batch in batches:
        values = batch.column("fp").to_numpy()
        for low in range(0, len(values), 256):
            own = values[low : low + 256]
            near = (own.view(np.uint64)[:, None] ^ flips).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(own, len(flips)))], names=["v", "fp"])


def links(distinct: DataFrame, n: int, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """Verified links (a, b) that connect whatever is linked among the n distinct fingerprints."""
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), block_count(n))).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    large = sizes.filter(F.col("n") > large_bucket)
    held = skew_join(keyed, sizes, ["t", "key"], "inner")
    small = held.filter(F.col("n") <= large_bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("members")).select("members")
    out = small.mapInArrow(_forests, "a long, b long")
    if large.limit(1).count():
        near = held.filter(F.col("n") > large_bucket).select("fp").distinct().mapInArrow(_near_values, "v long, fp long")
        out = out.unionByName(skew_join(near, near.groupBy("v").agg(F.min("fp").alias("m")), ["v"], "inner").filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")))
    return out


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, content, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach)."""
    prints = materialize(fingerprints(docs), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = materialize(links(classes.select("fp"), classes.count()), "links")  # read several times
    roots = connected_components(found)
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = skew_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), ["root"], "inner").select("fp", "component_id")
    return skew_join(prints, named, ["fp"], "inner").select("doc_id", "content", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
