"""Exact deduplication by content-defined chunk recipes.

Each text is normalised (white space deleted) and cut where a rolling hash of its last 32 bytes says so, hence at
the same places in equal passages. A chunk is known by a 64-bit key; the chunk dictionary verifies keys by
length and SHA-256, so two different chunks that share a key get different identifiers. A document becomes
its recipe, the ordered list of verified identifiers, and equal recipes are equal texts. Only keys and
identifiers are shuffled: no text leaves the task that read it.

Defined results: a null text counts as empty, all empty texts are one group; of repeated rows (equal doc_id and
text) exactly one is kept; texts of any length are read whole and hashed in segments; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, materialize, skew_join, text_or_empty

WINDOW = 32
MIN_CHUNK, MAX_CHUNK = 256, 8192
CUT_MASK = 1023  # a cut about every 1,024 bytes
SEGMENT = 4 << 20  # bytes hashed at once, so a huge document needs no huge arrays

RECIPE_SCHEMA = "uid long, doc_id long, content long, n_points long, text_sha256 string, chunks array<struct<key:long,size:int,check:binary>>"


def _gear() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def candidates(data: bytes) -> np.ndarray:
    """Ends of all 32-byte windows whose hash asks for a cut, ascending."""
    gear, found = _gear(), []
    for begin in range(0, len(data), SEGMENT):
        low = max(0, begin - WINDOW + 1)
        h = gear[np.frombuffer(data, np.uint8, min(len(data), begin + SEGMENT) - low, low)]
        for shift in (1, 2, 4, 8, 16):  # after these, h sums the window's bytes, each shifted by its distance
            h[shift:] += h[:-shift] << np.uint32(shift)
        ends = np.flatnonzero((h >> np.uint32(16)) & np.uint32(CUT_MASK) == 0) + low + 1
        found.append(ends[ends > begin])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cuts(size: int, ends: list[int]) -> list[int]:
    """Chunk ends of a document of so many bytes: candidate ends, but no chunk under the least or over the greatest size."""
    out, last = [], 0
    for end in [*ends, size]:
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if end - last >= MIN_CHUNK and end < size:
            out.append(end)
            last = end
    if last < size:
        out.append(size)
    return out


def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk_type = pa.list_(pa.struct([("key", pa.int64()), ("size", pa.int32()), ("check", pa.binary())]))
    for batch in batches:
        texts = batch.column("text")
        for low, high in _blocks(texts):
            out, bare = [], [texts[i].as_py().encode().translate(None, SPACE_BYTES) for i in range(low, high)]
            offsets = np.cumsum([0, *map(len, bare)])
            ends = candidates(b"".join(bare))
            first = np.searchsorted(ends, offsets + WINDOW)  # a window must not begin in the document before
            last = np.searchsorted(ends, offsets)
            for i, data in enumerate(bare):
                own = (ends[first[i] : last[i + 1]] - offsets[i]).tolist()
                begin, chunks = 0, []
                for end in cuts(len(data), own):
                    chunk = data[begin:end]
                    chunks.append({"key": xxhash.xxh64_intdigest(chunk) - (1 << 63), "size": end - begin, "check": hashlib.sha256(chunk).digest()})
                    begin = end
                out.append((hashlib.sha256(data).hexdigest(), chunks))
            rows = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [rows.column("uid"), rows.column("doc_id"), rows.column("content"), rows.column("n_points"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], chunk_type)],
                names=["uid", "doc_id", "content", "n_points", "text_sha256", "chunks"],
            )


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about one segment of text."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1])
    low, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        total += size
        if total >= SEGMENT:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: uid, doc_id, content, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the most code points, then the smallest doc_id, stays.
    """
    # uid is fixed when the recipes are written, and read from there by everything that follows
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), F.length(text_or_empty()).cast("long").alias("n_points"), text_or_empty().alias("text"))
    base = materialize(source.mapInArrow(recipes, RECIPE_SCHEMA), "recipes")
    chunks = base.select("uid", F.posexplode("chunks").alias("pos", "chunk")).select("uid", "pos", "chunk.key", "chunk.size", "chunk.check")
    # The dictionary: a key with more than one (size, check) gets one identifier for each of them.
    known = chunks.groupBy("key", "size", "check").agg(F.lit(1).alias("one"))
    variants = known.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("size", "check"))).alias("variants")).filter(F.size("variants") > 1)
    variant = F.coalesce(F.array_position("variants", F.struct("size", "check")) - 1, F.lit(0)).cast("int")
    verified = skew_join(chunks, variants, ["key"]).select("uid", "pos", "key", variant.alias("variant"))
    lists = verified.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "variant"))), lambda x: F.struct(x["key"].alias("key"), x["variant"].alias("variant"))).alias("recipe"))
    empty = F.expr("cast(array() as array<struct<key:bigint,variant:int>>)")
    rows = base.select("uid", "doc_id", "content", "n_points", "text_sha256").join(lists, "uid", "left").withColumn("recipe", F.coalesce("recipe", empty))
    # null doc_ids come last among ties; uid decides between repeated rows
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    groups = rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = skew_join(rows, groups, ["recipe"])
    return out.select("uid", "doc_id", "content", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")



OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, pts, sha256(norm) AS text_sha256, norm FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY norm ORDER BY pts DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
