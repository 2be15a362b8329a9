"""op6 against the tokenizers library, and the automaton's table against gadgets applied to a whole table."""

import hashlib
import json
import random

import numpy as np
import pytest

from parley.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
ODD = [*"abcdefgh  \t\n\r\x00\x0b\x0c\x1c\x1f\x85", "é", "é", "Σ", "ΑΣ ", "ß", "İ", "ŉ", "ﬁ", "漢", "字", "あ", "😀", "‍", " ", " ", "　", "'s", "'LL", "'", "''ve", "1", "42", "٣", "²", "!?", "...", "the", "ing", "aaaa", "<", "<|endoftext|>", "|>", "﻿", "­"]


def odd_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["x<|endoftext|>y", "<|startoftext|>'s", "", "aaaaaaaaa " * 9, "a" * 3000, "\0", "\0 \0a"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.read_text(P.path("word_bpe_49k.json"))))


@pytest.mark.parametrize(("segment", "cache"), [(1 << 20, 150_000), (5, 3)])
def test_as_the_library(library, encoder, monkeypatch, segment, cache):
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", segment)
    monkeypatch.setattr(encoder.pieces, "size", cache)
    texts = odd_texts(4000)
    ids = encoder.encode_block(texts)
    for e, own, decoded in zip(library.encode_batch(texts, add_special_tokens=False), ids.to_pylist(), encoder.decode_block(ids).to_pylist()):
        assert own == e.ids and decoded == library.decode(e.ids, skip_special_tokens=False)


def test_words_of_many_merges(library, encoder):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))) for _ in range(5000)] + ["ab" * 500, "antidisestablishmentarianism", "m" * 777]
    assert encoder.encode_block(words).to_pylist() == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


class Toy:
    """A vocabulary of a few letters and random merges. No letter ends a word."""

    def __init__(self, rng, letters, merges):
        self.symbols = {i: (bytes([97 + i]), False) for i in range(letters)}
        self.symbols |= {letters + i: (bytes([97 + i]), True) for i in range(letters)}
        spelled, self.merges = dict(self.symbols), []
        for _ in range(merges):
            a, b = rng.choice(sorted(spelled)), rng.choice(sorted(spelled))
            new = (spelled[a][0] + spelled[b][0], spelled[b][1])
            if not spelled[a][1] and new not in spelled.values():
                self.merges.append((a, b, len(spelled)))
                spelled[len(spelled)] = new


def gadgets(toy):
    """arcs[state][label]: the table after each gadget has been applied to it as it stands."""
    ends = {t for t, (_, e) in toy.symbols.items() if e}
    arcs = {s: set(toy.symbols) for s in toy.symbols}
    for a, b, ab in toy.merges:
        if a not in arcs or b not in arcs or b not in arcs[a]:
            continue
        row = set(arcs[b])  # ab leads where b led from a
        arcs[a].discard(b)
        for s in arcs:
            if a in arcs[s]:
                arcs[s].add(ab)
        arcs[ab] = row | ({ab} if a in row else set())
        if b in ends:
            ends.add(ab)
    return arcs


def merged(toy, word):
    """The merges applied to a word one after another, each from the left."""
    letters = len(toy.symbols) // 2
    out = [c - 97 for c in word[:-1]] + [letters + word[-1] - 97]
    for a, b, ab in toy.merges:
        i = 0
        while i + 1 < len(out):
            if out[i : i + 2] == [a, b]:
                out[i : i + 2] = [ab]
            i += 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_table_and_paths(seed):
    rng = random.Random(seed)
    toy = Toy(rng, rng.randint(1, 3), rng.randint(1, 25))
    automaton = bpe.Automaton(toy)
    arcs = gadgets(toy)
    for s in arcs:
        assert {t for t in arcs if automaton.allows(s, t)} == arcs[s]
    for _ in range(200):
        word = bytes(97 + rng.randrange(len(toy.symbols) // 2) for _ in range(rng.randint(1, 14)))
        assert automaton.encode(word) == merged(toy, word)
    words = [bytes(97 + rng.randrange(len(toy.symbols) // 2) for _ in range(rng.randint(0, 60))) for _ in range(100)]
    assert [np.frombuffer(x, np.int32).tolist() for x in automaton.encode_many(words)] == [merged(toy, w) if w else [] for w in words]
    states, labels = map(np.array, zip(*[(s, t) for s in arcs for t in arcs]))
    assert automaton.allow(states, labels).tolist() == [t in arcs[s] for s in arcs for t in arcs]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": None}])
def test_other_files_are_refused(change):
    spec = json.loads(bpe.read_text(P.path("word_bpe_49k.json")))
    with pytest.raises(ValueError, match="not a lower-casing"):
        bpe.Vocabulary(json.dumps(spec | change))


def test_one_token_by_two_merges_is_refused():
    toy = Toy(random.Random(1), 1, 0)
    toy.merges = [(0, 0, 2), (2, 0, 3), (0, 2, 3)]
    with pytest.raises(ValueError, match="two merges"):
        bpe.Automaton(toy)


def test_documents(spark, library, tmp_path):
    rows = [(1, "The cat's 42 hats"), (1, "The cat's 42 hats"), (None, "x"), (2, None), (3, ""), (4, " \n"), (5, "word " * 300_000 + "é" * 50_000), (6, "a<|endoftext|>b")]
    spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, ids string, decoded string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, bpe.op6_bpe(spark, str(tmp_path)).collect()), key=repr)
    sha, want = lambda x: hashlib.sha256(x.encode()).hexdigest(), []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = bpe.op6_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0
