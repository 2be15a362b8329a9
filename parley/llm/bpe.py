"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. At first it has one state with an arc for each symbol; then the merges are compiled into it in rank
order, one gadget each. The gadget of a merge (a, b): wherever state p has an arc a to q and q an arc b to r, p gets an arc ab to r, and
q loses its arc b. As all arcs of a label enter one state, a state is the token read last, and the table of states and labels changes
by whole lines: the new state ab starts as a copy of state b's row, the new label ab as a copy of label a's column, and the cell (a, b) is
emptied. The table has two thousand million cells for 49,000 tokens, so it is kept as these three changes a merge and a cell is read
by following the copies back to the symbols. A word's tokens are the labels of the one path that spells it.

Encoding follows the table, for all new words of a block in step: from the end of a prefix's path, a trie of the tokens' bytes gives the arcs that go on, and the
automaton says which of them its state has. Each prefix of a word has one path at most, so this takes a number of steps linear in the word.
Decoding emits the labels of ids. Pieces between white space are kept with their ids in caches of bounded size.

Defined results: null and empty texts have no tokens; added tokens of the vocabulary that occur in a text are single ids, as
in the tokenizers library; repeated rows each get their own row; an empty table gives an empty table; other columns are ignored; texts of
any length are encoded whole, in segments that end at white space, so a task holds one segment's pieces and one document's ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, worker_cache

CACHE_PIECES, CACHE_CELLS = 200_000, 500_000
LONG_PIECE = 64  # characters; longer pieces are not kept
LANE_BYTES = 48  # longer words are read one by one
BLOCK_CHARS, SEGMENT_CHARS = 6_000_000, 1 << 20

#: Fixed value: a pattern by which a piece of letters alone is one word.
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints in Latin-1, else the next free character from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in prints else free))
        free += b not in prints
    return out


class Vocabulary:
    """The parts of a byte-level tokenizer file with word-end marks that encoding needs. json_text: the file's content."""

    def __init__(self, json_text: str):
        spec = json.loads(json_text)
        model, ids = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        norms, splits = ((spec[x] or {}).get(y, []) for x, y in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        known = [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in splits] == ["Split", "ByteLevel"]
        known = known and norms[1]["pattern"] == {"Regex": r"\s+"} and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        if not known or not suffix or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("the file is not a lower-casing byte-level BPE with word-end marks, one splitting pattern and plain added tokens")
        self.labels = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = splits[0]["pattern"]["Regex"]
        symbols = byte_symbols()
        if any(s not in ids or s + suffix not in ids for s in symbols):
            raise ValueError("the vocabulary lacks a byte")
        #: symbol id -> (its byte, whether it ends a word)
        self.symbols = {ids[s]: (bytes([b]), False) for b, s in enumerate(symbols)} | {ids[s + suffix]: (bytes([b]), True) for b, s in enumerate(symbols)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]


class Numbers:
    """A fixed map from numbers to numbers, looked up by arrays: open addressing, one probe for most keys."""

    def __init__(self, entries: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(entries)) for x in (entries.keys(), entries.values()))
        self.shift = np.uint64(64 - max(4, (4 * len(entries)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values, self.mask = np.full(size, -1, np.int64), np.full(size, -1, np.int32), size - 1
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for a place the last one stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.values[at] = values

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Automaton:
    """The tokenization automaton of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.spelled = dict(vocabulary.symbols)
        self.made = dict.fromkeys(self.spelled, -1)  # token -> the number of its gadget; -1 for symbols
        self.first: dict[int, int] = {}  # token ab -> a, whose column its own was copied from
        self.second: dict[int, int] = {}  # token ab -> b, whose row its own was copied from
        self.emptied: dict[int, int] = {}  # cell -> the number of the gadget that emptied it
        self.read: dict[int, bool] = {}
        for number, (a, b, ab) in enumerate(vocabulary.merges):
            self._gadget(number, a, b, ab)
        self._spell()
        most = max(self.made) + 1
        self.columns = np.full((3, most), -1, np.int32)  # made, first and second by token
        for row, of in zip(self.columns, (self.made, self.first, self.second)):
            row[np.fromiter(of.keys(), np.int64, len(of))] = np.fromiter(of.values(), np.int64, len(of))
        self.arcs, self.holes = Numbers(self.step), Numbers(self.emptied)
        self.ends = np.array([self.inner, self.final], np.int32)

    def _gadget(self, number: int, a: int, b: int, ab: int) -> None:
        if ab in self.made:
            raise ValueError("two merges make one token, so a state would have two rows")
        if a not in self.made or b not in self.made or not self._cell(a, b, number):
            return  # no path has a and then b, so no arc ab comes to be
        self.first[ab], self.second[ab], self.made[ab] = a, b, number
        self.emptied[a << 32 | b] = number
        self.spelled[ab] = (self.spelled[a][0] + self.spelled[b][0], self.spelled[b][1])

    def _spell(self) -> None:
        """The trie of the tokens' bytes: step[node << 8 | byte], and at each node the token within and that at the end of a word."""
        self.step: dict[int, int] = {}
        self.inner, self.final = [-1], [-1]
        for token, (spelling, ends) in self.spelled.items():
            node = 0
            for byte in spelling:
                after = self.step.setdefault(node << 8 | byte, len(self.inner))
                if after == len(self.inner):
                    self.inner.append(-1)
                    self.final.append(-1)
                node = after
            (self.final if ends else self.inner)[node] = token

    def _cell(self, state: int, label: int, number: int) -> bool:
        """Whether state has an arc label before the gadget of this number."""
        made, emptied = self.made, self.emptied
        while True:
            gone = emptied.get(state << 32 | label)
            if gone is not None and gone < number:
                return False
            row, column = made[state], made[label]
            if row < 0 and column < 0:
                return True
            # A row is copied before its gadget empties the cell, a column afterwards: in a run of one symbol the leftmost pair merges.
            if row > column:
                state, number = self.second[state], row
            else:
                label, number = self.first[label], column + 1

    def allows(self, state: int, label: int) -> bool:
        """Whether the finished automaton has an arc label in state."""
        cell = state << 32 | label
        found = self.read.get(cell)
        if found is None:
            if len(self.read) >= CACHE_CELLS:
                self.read.clear()
            found = self.read[cell] = self._cell(state, label, len(self.made))
        return found

    def encode(self, word: bytes) -> list[int]:
        """The labels of the path that spells a word. The start has an arc for every token.

        Longer arcs are tried first. As one path at most leads to each place in the word, no place is reached twice.
        """
        step, inner, final, allows = self.step.get, self.inner, self.final, self.allows
        last, path, begin = len(word) - 1, [], 0
        left: list[list[tuple[int, int]]] = []  # the arcs not yet tried, as (end, token), at the start and after each token of the path
        while True:
            arcs, node = [], 0
            for end in range(begin, last):
                node = step(node << 8 | word[end])
                if node is None:
                    break
                if (token := inner[node]) >= 0:
                    arcs.append((end + 1, token))
            else:
                if (node := step(node << 8 | word[last])) is not None and (token := final[node]) >= 0:
                    arcs.append((last + 1, token))
            left.append(arcs)
            while True:
                while not left[-1]:
                    left.pop()
                    path.pop()
                begin, token = left[-1].pop()
                if not path or allows(path[-1], token):
                    break
            path.append(token)
            if begin > last:
                return path


    def allow(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """allows for arrays, by the same steps."""
        made, first, second = self.columns
        out, left = np.ones(len(states), bool), np.arange(len(states))
        states, labels, numbers = states.astype(np.int64), labels.astype(np.int64), np.full(len(states), len(self.made), np.int32)
        while len(left):
            gone = self.holes.get(states << 32 | labels)
            hole = (gone >= 0) & (gone < numbers)
            out[left[hole]] = False
            row, column = made[states], made[labels]
            on = ~hole & ((row >= 0) | (column >= 0))
            left, states, labels, row, column = left[on], states[on], labels[on], row[on], column[on]
            later = row > column
            numbers = np.where(later, row, column + 1)
            states, labels = np.where(later, second[states], states), np.where(later, labels, first[labels])
        return out

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """The labels of the paths of words, each as packed 32-bit numbers. Words are read in step, all prefixes' paths of each."""
        out: list[bytes] = [b""] * len(words)
        lanes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > LANE_BYTES:
                out[i] = array("i", self.encode(word)).tobytes()
            elif word:
                lanes.setdefault(-(-len(word) // 8) * 8, []).append(i)
        for width, chosen in lanes.items():
            for i, path in zip(chosen, self._paths([words[i] for i in chosen], width)):
                out[i] = path
        return out

    def _paths(self, words: list[bytes], width: int) -> Iterator[bytes]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        last, came = np.full((len(words), width + 1), -1, np.int32), np.zeros((len(words), width + 1), np.int64)
        for begin in range(width):
            at = np.flatnonzero((size > begin) & (last[np.arange(len(words)), size] < 0))
            node, state = np.zeros(len(at), np.int64), last[at, begin]
            for end in range(begin + 1, width + 1):
                node = self.arcs.get(node << 8 | data[at, end - 1])
                on = node >= 0
                at, node, state = at[on], node[on].astype(np.int64), state[on]
                if not len(at):
                    break
                token = self.ends[(size[at] == end).astype(np.int8), node]
                is_token = np.flatnonzero(token >= 0)
                if begin:
                    is_token = is_token[self.allow(state[is_token], token[is_token])]
                last[at[is_token], end], came[at[is_token], end] = token[is_token], begin
                on = size[at] > end
                at, node, state = at[on], node[on], state[on]
        place, labels = size.copy(), []
        rows = np.arange(len(words))
        while place.any():
            labels.append(np.where(place > 0, last[rows, place], -1))
            place = np.where(place > 0, came[rows, place], 0)
        table = np.array(labels[::-1], np.int32).T
        table = np.ascontiguousarray(table)
        counts = (table >= 0).sum(axis=1)
        for row, n in zip(table, counts.tolist()):
            yield row[len(row) - n :].tobytes()


class Recent:
    """What make gives for keys, kept for the keys of late: when the younger of two generations is full, the older goes."""

    def __init__(self, size: int, make: Callable[[list[str]], list[bytes]]):
        self.size, self.make, self.young, self.old = size, make, {}, {}

    def get(self, key: str) -> bytes | None:
        return self.young.get(key) or self.old.get(key)

    def of(self, keys: Iterable[str]) -> list[bytes]:
        """keys: distinct."""
        keys = list(keys)
        found = list(map(self.young.get, keys))
        missing = [i for i, value in enumerate(found) if value is None]
        fresh = []
        for i in missing:
            found[i] = self.old.get(keys[i])
            if found[i] is None:
                fresh.append(i)
        for i, value in zip(fresh, self.make([keys[i] for i in fresh])):
            found[i] = value
        for i in missing:
            if len(keys[i]) <= LONG_PIECE:
                if len(self.young) >= self.size:
                    self.young, self.old = {}, self.young
                self.young[keys[i]] = found[i]
        return found


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r]")


class Encoder:
    """Texts to ids and back, as the library does for such a file without a post-processor."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton, self.split = Automaton(vocabulary), regex.compile(vocabulary.pattern)
        self.letters = vocabulary.pattern == LETTERS  # pieces of letters are words
        self.pieces = Recent(CACHE_PIECES, self._ids)
        self.added = vocabulary.added
        self.find_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.whole = any(map(_SPACE.search, self.added))  # a cut at white space could part an added token
        self.labels = pa.array([vocabulary.labels.get(i, "") for i in range(max(vocabulary.labels) + 1)])

    def _words(self, piece: str) -> list[str]:
        return [piece] if self.letters and piece.isalpha() else self.split.findall(piece)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, each as packed 32-bit numbers."""
        words = [() if p[0] == " " else self._words(p) for p in pieces]
        known: dict[str, bytes | None] = {w: None for ws in words for w in ws}
        for w in known:
            known[w] = self.pieces.get(w)  # a word is a piece too
        new = [w for w, ids in known.items() if ids is None]
        known.update(zip(new, self.automaton.encode_many([w.encode() for w in new])))
        return [array("i", [self.added[p[1:]]]).tobytes() if p[0] == " " else b"".join([known[w] for w in ws]) for p, ws in zip(pieces, words)]

    def _segments(self, text: str) -> Iterator[str]:
        low = 0
        while len(text) - low > SEGMENT_CHARS and not self.whole and (m := _SPACE.search(text, low + SEGMENT_CHARS)):
            yield text[low : m.start()]
            low = m.start()
        yield text[low:] if low else text

    def split_text(self, text: str) -> list[str]:
        """The normalised text's pieces between white space; an added token has a space before it, which no piece has."""
        if any(map(text.__contains__, self.added)):
            out, last = [], 0
            for m in self.find_added.finditer(text):
                out += [*self._plain(text[last : m.start()]), " " + m[0]]
                last = m.end()
            return out + self._plain(text[last:])
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # the library lower-cases character by character, so no sigma is final
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if _ODD_SPACE.search(text):  # Python splits at these, the library does not
            return [x for x in regex.split(r"[^\S\x1c-\x1f]+", text) if x]
        return text.split()

    def encode_block(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        numbers = _Numbers()
        runs, ends = [np.empty(0, np.int32)], [0]
        for text in texts:
            own = [np.fromiter(map(numbers.__getitem__, self.split_text(x)), np.int32) for x in self._segments(text)]
            runs += own
            ends.append(ends[-1] + sum(map(len, own)))
        at, packed = np.concatenate(runs), self.pieces.of(numbers)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        upto = np.concatenate([[0], np.cumsum(sizes[at])])
        flat = np.frombuffer(b"".join(packed), np.int32)
        ids = flat[np.arange(upto[-1]) + np.repeat(starts[at] - upto[:-1], sizes[at])]
        return pa.ListArray.from_arrays(pa.array(upto[ends], pa.int32()), pa.array(ids))

    def decode_block(self, ids: pa.ListArray) -> pa.Array:
        """The labels of each list of ids, joined by spaces."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.labels.take(ids.values)), " ")


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def blocks(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of about so many characters in total."""
    out, size = [], 0
    for text in texts:
        out.append(text)
        size += len(text)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded for each row of docs. path: a tokenizer file, read on the driver.

    The vocabulary has the size of its file, whatever the corpus, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_text(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_cache("bpe")
        key = hashlib.sha256(shared.value.encode()).hexdigest()
        if key not in known:
            known[key] = Encoder(Vocabulary(shared.value))
        encoder = known[key]
        for batch in batches:
            low = 0
            for block in blocks((x.as_py() or "" for x in batch.column("text")), BLOCK_CHARS):
                ids = encoder.encode_block(block)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(block)), ids, encoder.decode_block(ids)], names=["doc_id", "ids", "decoded"])
                low += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
