"""Best-fit packing with certified bin counts.

Documents become token pieces; pieces shorter than a sequence are dealt into partitions of about PARTITION_PIECES, and each partition packs its own
by best-fit decreasing. A dual-feasible-function bound then certifies how few bins any packing of the partition needs, and the same bound of all pieces, from
how many there are of each length, how few the whole table needs. While the sum of all bins is above that, each partition gives back its emptiest
bins, up to a FAN_IN-th of what a task packs. Given-back documents of FAN_IN partitions meet in one, which
is thus no larger than a first one, and best-fit decreasing runs again, until one partition is left. If a gap is left even then, the emptiest bins of the whole table, as
many as a task packs, are packed anew once, and the better packing stays. What is
exchanged is rows of a few numbers, never token ids. Each piece tells the bins and the bound of the partition that packed it last.

Defined results: null and empty texts are one piece of the end token; repeated rows each get their own pieces; an empty table
gives an empty table; other columns are ignored; a text of any length is cut, never dropped.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLOCK_CHARS, blocks, byte_symbols, read_text
from .common import materialize, table, worker_cache

CAPACITY = 2048
PARTITION_PIECES = 50_000  # pieces that one task packs
FAN_IN = 8  # partitions whose given-back documents meet in the next round

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Fixed value: the pattern by which byte-level tokenizers split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
SEGMENT_CHARS = 1 << 20


class Tokens:
    """Texts to packed little-endian 32-bit ids, as the tokenizers library gives them.

    Where the file splits by the byte-level pattern, normalises nothing and numbers its merges in order, tiktoken applies the same merges, several times as fast; any other
    file, and any text with an added token, goes to the tokenizers library itself. Very long texts are encoded in segments that end before a lone
    space: the byte-level pattern never joins what such a space parts, so the segments' ids, one after another, are the text's.
    """

    def __init__(self, json_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(json.loads(json_text))

    def _ranked(self, spec: dict):
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter["add_prefix_space"] and not spec["normalizer"]
        if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        ids, code = model["vocab"], {c: b for b, c in enumerate(byte_symbols())}
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or min(merged, default=256) < 256 or model["end_of_word_suffix"]:
            return None
        import tiktoken

        ranks = {bytes(code[c] for c in token): i for token, i in ids.items() if all(c in code for c in token)}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if not self.ranked or any(a in text for a in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(text) <= SEGMENT_CHARS:
            return array("I", self.ranked(text)).tobytes()
        out, low = [], 0
        while low < len(text):
            m = _LONE_SPACE.search(text, low + SEGMENT_CHARS)
            high = m.start() if m else len(text)
            out.append(array("I", self.ranked(text[low:high])).tobytes())
            low = high
        return b"".join(out)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of packed ids: one piece, or if too long whole pieces after one that may be shorter."""
    n = len(ids) // 4
    ends = list(range(n % capacity or capacity, n + 1, capacity))
    for piece, end in enumerate(ends):
        start = ends[piece - 1] if piece else 0
        yield piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The token pieces of each document, its end id included. path: a tokenizer file, read on the driver; its size does not grow."""
    shared = docs.sparkSession.sparkContext.broadcast(read_text(path))
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("tokens")
        key = hashlib.sha256(shared.value.encode()).hexdigest()
        if key not in known:
            known[key] = Tokens(shared.value)
        for batch in batches:
            ids, low = batch.column("doc_id").to_pylist(), 0
            for block in blocks((x.as_py() or "" for x in batch.column("text")), BLOCK_CHARS):
                rows = [(doc, *p) for doc, text in zip(ids[low:], block) for p in cut(known[key].encode(text) + end, capacity)]
                low += len(block)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenize, PIECE)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The greatest of the dual-feasible-function bounds (Martello and Toth's family) on the bins that sizes need."""
    return bound_of(np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound from how many pieces there are of each size."""
    count = count.astype(np.int64)
    if not count.any():
        return 0
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    least = np.arange(half + 1)  # the function rounds sizes under `least` to nothing and those over capacity - least to whole bins
    large = number[capacity] - number[capacity - least]
    middle = number[capacity - least] - number[half]
    room = middle * capacity - (total[capacity - least] - total[half])
    small = total[half] - np.where(least > 0, total[np.maximum(least - 1, 0)], 0)
    return int((large + middle + np.maximum(0, -(-(small - room) // capacity))).max())


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin and the place in it of each size, and the room left in each bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places, room, open_rooms = [0] * len(sizes), [0] * len(sizes), [], 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fit = open_rooms >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], places[i], left = b, capacity - r, r - size
        room[b] = left
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, places, room


def _packer(last: bool, capacity: int, give: int) -> Callable[[pa.Table], pa.Table]:
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("uid", "ascending")])  # the same packing however rows arrive
        sizes = group.column("length").to_numpy()
        bins, places, room = best_fit(sizes.tolist(), capacity)
        back: list[int] = []
        if not last:
            unfilled = sorted((b for b in range(len(room)) if room[b]), key=lambda b: -room[b])
            held = np.cumsum(np.bincount(bins, minlength=len(room))[unfilled]) if unfilled else np.empty(0, int)
            back = unfilled[: max(1, int(np.searchsorted(held, give, "right")))]
        flags = np.zeros(len(room), bool)
        flags[back] = True
        alike = lambda n: pa.array([n] * len(bins), pa.int64())
        own = {"bin": pa.array(bins, pa.int64()), "offset": pa.array(places, pa.int64()), "room": pa.array(np.array(room)[bins], pa.int64()), "back": pa.array(flags[bins]), "bins": alike(len(room)), "bound": alike(lower_bound(sizes, capacity))}
        for name, column in own.items():
            group = group.append_column(name, column)
        return group

    return pack


def pack(parts: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id, offset, bins and bound. No length may exceed the capacity.

    bins and bound: of the partition that packed the piece last, null for pieces that fill a sequence.
    """
    parts = materialize(parts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    fields = [c.strip().split(" ")[0] for c in PIECE.split(",")]
    unknown = [F.lit(None).cast("long").alias(x) for x in ("bins", "bound")]
    full = parts.filter(F.col("length") == capacity).select(*fields, (F.col("uid") + (1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *unknown)
    rest = parts.filter(F.col("length") < capacity)
    count = np.zeros(capacity + 1, np.int64)
    for row in rest.groupBy("length").count().collect():  # a row for each length under the capacity
        count[row["length"]] = row["count"]
    least, groups, give = bound_of(count, capacity), max(1, -(-int(count.sum()) // partition_pieces)), max(1, partition_pieces // FAN_IN)
    schema = f"{PIECE}, uid long, part long, bin long, offset long, room long, back boolean, bins long, bound long"

    def packed(rows: DataFrame, round_: int, last: bool) -> DataFrame:
        out = materialize(rows.groupBy("part").applyInArrow(_packer(last, capacity, give), schema), "packed")
        # parts and bins stay under 2^27: a part holds about partition_pieces at most
        return out.withColumn("sequence_id", F.lit(round_ << 54) + F.col("part") * (1 << 27) + F.col("bin"))

    rest = rest.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    settled: list[DataFrame] = []
    round_, n_settled, before, given = 0, 0, None, None  # before: the last round's bins that were given back
    while True:
        now = packed(rest, round_, groups == 1)
        by_part = now.groupBy("part").agg(F.max("bins").alias("bins"), F.count_distinct(F.when(F.col("back"), F.col("bin"))).alias("back"))
        bins, back = (x or 0 for x in by_part.agg(F.sum("bins"), F.sum("back")).first())
        if given is not None and bins > given:  # the former packing of these pieces was better
            settled.append(before)
            n_settled += given
            break
        if groups == 1 or not back or n_settled + bins <= least:
            settled.append(now)
            n_settled += bins
            break
        settled.append(now.filter("NOT back"))
        n_settled += bins - back
        before, given = now.filter("back"), back
        groups, round_ = -(-groups // FAN_IN), round_ + 1
        rest = before.select(*fields, "uid", F.floor(F.col("part") / FAN_IN).alias("part"))
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    if n_settled > least and len(settled) > 1:
        pieces_by_room = sorted((tuple(r) for r in out.filter("room > 0").groupBy("room").count().collect()), reverse=True)  # a row for each room
        held = np.cumsum([n for _, n in pieces_by_room])
        taken = int(np.searchsorted(held, partition_pieces, "right"))
        if taken:
            pool = F.col("room") >= pieces_by_room[taken - 1][0]
            now = packed(out.filter(pool).select(*fields, "uid", F.lit(0).cast("long").alias("part")), round_ + 1, True)
            if now.agg(F.max("bins")).first()[0] < out.filter(pool).select("sequence_id").distinct().count():
                out = out.filter(~pool).unionByName(now)
    return full.unionByName(out.select(*fields, "sequence_id", "offset", "bins", "bound"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
