"""Adjacency pairs: for each rule a stream with its links written out by hand, and properties that hold for any stream."""

import random

import pytest

from parley.operators.links import build_links, nearest_reply, notes

SCHEMA = "meeting string, position int, seg_id string, source_da_id string, adjacency_raw string, is_layer2_proposal boolean"
NOTES = ("numbering_restarts", "a_continuation_without_group", "b_without_group", "b_continuation_ambiguous", "b_continuation_without_chain")

# name: (acts as "id:adjacency" or "id*segments:adjacency", links as {id: (chains, status, pair_group)}, notes that are not zero)
CASES = {
    "a reply joins the open pair": ("A:1a B:1b", {"A": ("B", "ok", "1@0")}, {}),
    "without a reply there is no pair": ("A:1a B:", {"A": ("", "no_pair", "1@0")}, {}),
    "an act without adjacency has no group": ("A:- B:1b", {"A": ("", "no_pair", None)}, {"b_without_group": 1}),
    "each speaker has a chain": ("A:1a B:1b-1 C:1b-2 D:1b-1", {"A": ("B,D C", "ok", "1@0")}, {}),
    "a plain reply is speaker nought's": ("A:1a B:1b-1 C:1b D:1b", {"A": ("B C,D", "ok", "1@0")}, {}),
    "all segments of a reply join once": ("A:1a B*2:1b.1b C:1b", {"A": ("B0,B1,C", "ok", "1@0")}, {}),
    "every segment of a proposal has the link": ("A*2:1a B:1b", {"A0": ("B", "ok", "1@0"), "A1": ("B", "ok", "1@0")}, {}),
    "a plus continues the pair": ("A:1a B:1a+ C:1b", {"A": ("C", "ok", "1@0"), "B": ("C", "ok", "1@0")}, {}),
    "another speaker's a continues the pair": ("A:1a B:1a-2 C:1b", {"A": ("C", "ok", "1@0"), "B": ("C", "ok", "1@0")}, {}),
    "speaker one opens": ("A:1a B:1b C:1a-1 D:1b", {"A": ("B", "ok", "1@0"), "C": ("D", "ok", "1@2")}, {}),
    "an opener replaces the pair of its number": ("A:1a B:1b C:1a D:1b E:1b", {"A": ("B", "ok", "1@0"), "C": ("D,E", "ok", "1@2")}, {}),
    "a continuation of nothing is ambiguous": ("A:1a+ B:1b", {"A": ("B", "ambiguous", "1@0")}, {"a_continuation_without_group": 1}),
    "an opener after such a continuation is not": ("A:1a+ B:1a C:1b", {"A": ("", "ambiguous", "1@0"), "B": ("C", "ok", "1@1")}, {"a_continuation_without_group": 1}),
    "underscores make another pair": ("A:1a B:1_a C:1_b D:1b", {"A": ("D", "ok", "1@0"), "B": ("C", "ok", "1_@1")}, {}),
    "number one after a higher one restarts": ("A:2a B:1a C:2b D:1b", {"A": ("", "no_pair", "2@0"), "B": ("D", "ok", "1@1")}, {"numbering_restarts": 1, "b_without_group": 1}),
    "a higher number with underscores does not count": ("A:2_a B:1a C:2_b", {"A": ("C", "ok", "2_@0"), "B": ("", "no_pair", "1@1")}, {}),
    "an underscored one does not restart": ("A:2a B:1_a C:2b", {"A": ("C", "ok", "2@0"), "B": ("", "no_pair", "1_@1")}, {}),
    "a continued one does not restart": ("A:2a B:1a+ C:2b", {"A": ("C", "ok", "2@0"), "B": ("", "ambiguous", "1@1")}, {"a_continuation_without_group": 1}),
    "a second restart needs a higher number since the first": ("A:2a B:1a C:1a D:2a E:1a F:2b", {"A": ("", "no_pair", "2@0"), "B": ("", "no_pair", "1@1"), "C": ("", "no_pair", "1@2"), "D": ("", "no_pair", "2@3"), "E": ("", "no_pair", "1@4")}, {"numbering_restarts": 2, "b_without_group": 1}),
    "a continuing b joins chain nought": ("A:1a B:1b-2 C:1b D:1b+", {"A": ("B C,D", "ok", "1@0")}, {}),
    "a continuing b joins the only chain": ("A:1a B:1b-2 C:1b+", {"A": ("B,C", "ok", "1@0")}, {}),
    "a continuing b of several chains makes the group ambiguous": ("A:1a B:1b-1 C:1b-2 D:1b+ E:1b-1", {"A": ("B,E C", "ambiguous", "1@0")}, {"b_continuation_ambiguous": 1}),
    "a continuing b of no chain is lost": ("A:1a B:1b+ C:1b", {"A": ("C", "ok", "1@0")}, {"b_continuation_without_chain": 1}),
    "a continuing b with a speaker is that speaker's": ("A:1a B:1b-1 C:1b-2+", {"A": ("B C", "ok", "1@0")}, {}),
    "a malformed piece marks the act, its other tokens count": ("A:1a.zz B:1b", {"A": ("B", "malformed", "1@0")}, {}),
    "an empty adjacency is malformed": ("A:'' B:1b", {"A": ("", "malformed", None)}, {"b_without_group": 1}),
    "an act of two pairs has the chains of both": ("A:1a.2a B:2b C:1b", {"A": ("B C", "ok", "1@0")}, {}),
    "a reply to two pairs is in both": ("A:1a B:2a C:1b.2b", {"A": ("C", "ok", "1@0"), "B": ("C", "ok", "2@1")}, {}),
    "a reply that proposes has both sides": ("A:1a B:1b.2a C:2b", {"A": ("B", "ok", "1@0"), "B": ("C", "ok", "2@1")}, {}),
}


def rows_of(meeting, text):
    out, place = [], 0
    for act in text.split(" "):
        name, adjacency = act.split(":")
        name, _, many = name.partition("*")
        raw = {"-": None, "''": ""}.get(adjacency, adjacency or None)
        for n in range(int(many or 1)):
            out.append((meeting, place, f"{name}{n}" if many else name, name, raw, True))
            place += 1
    return out


def unique(rows):
    """Ids that differ between meetings."""
    return [(m, p, f"{m}/{s}", f"{m}/{a}", raw, is_p) for m, p, s, a, raw, is_p in rows]


@pytest.fixture(scope="module")
def all_cases(spark):
    rows = [r for i, (text, _, _) in enumerate(CASES.values()) for r in unique(rows_of(f"m{i}", text))]
    return {r["proposal_id"]: r for r in build_links(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_links_by_hand(all_cases, name):
    meeting, (_, wanted, _) = f"m{list(CASES).index(name)}", CASES[name]
    for act, (chains, status, group) in wanted.items():
        got = all_cases[f"{meeting}/{act}"]
        assert [",".join(s.split("/")[1] for s in c) for c in got["responder_chains"]] == chains.split()
        assert got["status"] == status and got["has_response"] == bool(chains) and got["pair_group"] == (group and f"{meeting}:{group}")


def test_notes_by_hand(spark):
    total = dict.fromkeys(NOTES, 0)
    for _, _, found in CASES.values():
        for k, n in found.items():
            total[k] += n
    rows = [r for i, (text, _, _) in enumerate(CASES.values()) for r in unique(rows_of(f"m{i}", text))]
    assert notes(spark.createDataFrame(rows, SCHEMA)).first().asDict() == total


def test_properties_of_any_stream(spark):
    rng = random.Random(1)
    token = lambda: f"{rng.randint(1, 3)}{'_' * (rng.random() < 0.2)}{rng.choice('abb')}{rng.choice(['', '', '-1', '-2'])}{'+' * (rng.random() < 0.2)}"
    rows = []
    for m in range(60):
        acts = [f"A{i}*{rng.randint(1, 3)}:{'.'.join(token() for _ in range(rng.randint(1, 3)))}" for i in range(rng.randint(2, 25))]
        rows += unique(rows_of(f"r{m}", " ".join(acts)))
    place, raw, act = ({r[2]: r[i] for r in rows} for i in (1, 4, 3))
    df = spark.createDataFrame(rows, SCHEMA)
    links = {r["proposal_id"]: r for r in build_links(df).collect()}
    assert set(links) == set(place)  # one link for each proposal
    keys = lambda s, side: {t.split(side)[0] for t in raw[s].split(".") if side in t}
    for s, link in links.items():
        chains = link["responder_chains"]
        assert link["status"] in ("ok", "no_pair", "ambiguous") and (link["status"] == "ambiguous" or (link["status"] == "ok") == bool(chains))
        assert (link["pair_group"] is None) == (not keys(s, "a"))
        heads = [place[c[0]] for c in chains]
        assert heads == sorted(heads)
        for chain in chains:
            assert [place[x] for x in chain] == sorted({place[x] for x in chain})
            # who replies has a b of a number that the proposal has as an a, and says it after the pair was opened
            assert all(x.split("/")[0] == s.split("/")[0] and keys(x, "b") & keys(s, "a") for x in chain)
    for a in {act[s] for s in place}:  # an act's segments share a link
        assert len({str(links[s]["responder_chains"]) + links[s]["status"] + str(links[s]["pair_group"]) for s in place if act[s] == a}) == 1
    alone = {r["proposal_id"]: r for r in build_links(df.filter("meeting IN ('r0', 'r1')")).collect()}
    assert all(alone[s] == links[s] for s in alone)  # meetings do not meet


def test_nearest_reply(spark):
    df = spark.createDataFrame(unique(rows_of("m", "A:1a B: C: D:1b-1 E:1b F:2a")), SCHEMA)
    assert {r["proposal_id"]: r["distance"] for r in nearest_reply(build_links(df), df).collect()} == {"m/A": 3}
