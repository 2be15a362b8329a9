"""Personal data, found in plain and in disguised form.

The plain form is matched on the text as it is. For disguises, a cascade of transducers rewrites the text: look-alike letters and digits of
other scripts become ASCII one for one, invisible characters vanish, runs of spelled digits become digits, and at/dot disguises become
"@" and ".". Each transducer keeps where it has changed the length, by which every character it emits has the range of source characters that
it stands for. The same detectors read the last tape, and what they find is mapped back to source characters.
Plain spans always stay; a disguised span is added unless a plain span of its kind covers it.

A transducer runs wherever its own pattern matches. "name at host.label" and "name at host dot label" are addresses where the last
label is in LAST_LABELS (all country codes, the common generic ones), so "look at example.com" is masked too; other last labels are left as prose.

Detectors and transducers take time linear in the text (look-ups among changes add a logarithm), and hold some copies of it and a few numbers
for each change. Offsets count code points, ends are exclusive.

Defined results: null and empty texts have no spans; texts of any length are read whole; repeated rows each get their own row; an empty
table gives an empty table; other columns are ignored (detect) or passed through (redact).
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")

#: Characters of other scripts that look like an ASCII letter.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "κк", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ԝѡ",
    "x": "хχ", "y": "уү", "z": "ᴢ", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "@": "﹫", ".": "․。｡", "-": "‐‑‒–−", "+": "﬩",
}
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Digit words.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
REPEATS = {"double": 2, "triple": 3}
#: Country codes.
COUNTRIES = (
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp "
    "ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om "
    "pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()
#: Last labels that make "name at host dot label" an address rather than prose.
LAST_LABELS = (*"com org net edu gov mil int info biz name pro mobi coop aero jobs travel museum arpa asia cat tel app dev xyz online site shop store tech cloud blog email live club world space website agency digital company network systems solutions academy media news page link wiki design studio group team one top vip".split(), *COUNTRIES)

# The digit-range detectors start only where no digit precedes: a later start in a run of digits has the same continuation.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Driven by the at signs: a local part is the run before one, as far as no address before it has taken it."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        floor = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", floor)


def _is_part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def find_plain(text: str) -> list[tuple[str, int, int]]:
    """The spans (kind, start, end) of a text as it is, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_is_part, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Tape:
    """A text made from another by changes of some parts; before is the tape it was made from, None for a source.

    outs, ends: where the changed parts lie in this text; from_, to: where they lay in the one before. Four numbers a change.
    """

    def __init__(self, text: str, before: Tape | None = None):
        self.text, self.before = text, before
        self.outs, self.ends, self.from_, self.to = (array("q") for _ in range(4))

    def rewrite(self, pattern: re.Pattern, output: Callable[[re.Match], str]) -> Tape:
        """The transducer that copies, but emits output(match) for each match; all it emits stands for the whole match."""
        out, parts, last, shift = Tape("", self), [], 0, 0
        for m in pattern.finditer(self.text):
            s, e = m.span()
            new = output(m)
            if new == m[0]:
                continue
            parts += [self.text[last:s], new]
            out.outs.append(s + shift)
            out.from_.append(s)
            shift += len(new) - (e - s)
            out.ends.append(e + shift)
            out.to.append(e)
            last = e
        if not last:
            return self
        out.text = "".join([*parts, self.text[last:]])
        return out

    def _range(self, at: int) -> tuple[int, int]:
        """The range of the text before that the character at this place stands for."""
        i = bisect_right(self.outs, at) - 1
        if i < 0:
            return at, at + 1
        if at < self.ends[i]:
            return self.from_[i], self.to[i]
        at += self.to[i] - self.ends[i]
        return at, at + 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The range of the source that the characters from start to end (exclusive) stand for."""
        tape: Tape | None = self
        while tape.before is not None:
            start, end = tape._range(start)[0], tape._range(end - 1)[1]
            tape = tape.before
        return start, end


def _character_map() -> dict[str, str]:
    out = {x: ascii_ for ascii_, others in LOOKALIKES.items() for x in others}
    out |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # digits of other scripts and styles
        out |= {chr(zero + i): str(i) for i in range(10)}
    return out | dict.fromkeys(INVISIBLE, "")


CHARACTERS = _character_map()
_ONE_FOR_ONE = str.maketrans({x: y for x, y in CHARACTERS.items() if y})
_ODD = re.compile("[" + "".join(map(re.escape, CHARACTERS)) + "]")
_UNSEEN = re.compile(f"[{INVISIBLE}]+")
_WORD = "(?:" + "|".join(DIGIT_WORDS) + ")"
_UNIT = rf"(?:(?:double|triple)[\x20-]+)?(?:{_WORD}|[0-9])"
# Only a run of at least three is rewritten, so that "one two" in prose stays as it is.
_SPELLED = re.compile(rf"(?i)\b(?:plus[\x20]+)?{_UNIT}(?:[\x20,-]++{_UNIT}){{2,}}\b")
_TOKEN = re.compile(rf"(?i)double|triple|plus|{_WORD}|[0-9]")
_DIGIT_WORD = re.compile(rf"(?i){_WORD}")
_AT = re.compile(r"(?i)[\x20]?[\[({<][\x20]?(?:at|@)[\x20]?[\])}>][\x20]?")
_DOT = re.compile(r"(?i)[\x20]?[\[({<][\x20]?(?:dot|\.)[\x20]?[\])}>][\x20]?|(?<=[0-9])[\x20]++dot[\x20]++(?=[0-9])")
_LABEL = r"[A-Za-z0-9-]++"
_SAID = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[\x20]++at[\x20]++|@){_LABEL}(?:(?:[\x20]++dot[\x20]++|\.){_LABEL})*(?:[\x20]++dot[\x20]++|\.)(?:{'|'.join(LAST_LABELS)})\b")
# evidence that is sought in lower-case text before a pattern is: what every match of it must show
_NEXT_UNIT = re.compile(rf"[\x20,-]++(?:{'|'.join(REPEATS)}|{_WORD}|[0-9])")
_ENDING = re.compile(rf"\.(?=[a-z])(?:{'|'.join(LAST_LABELS)})\b")
_CASE_ODD = "\u017f\u0130\u0131\u212a"  # they match s, i and k without regard to case, but their lower-case text has other characters
# only the first of a run of spaces starts a gap, so that a run is read once
_GAP_AT, _GAP_DOT = re.compile(r"(?i)(?<!\x20)[\x20]++at[\x20]++"), re.compile(r"(?i)(?<!\x20)[\x20]++dot[\x20]++")


def _digits(m: re.Match) -> str:
    if not _DIGIT_WORD.search(m[0]):
        return m[0]  # plain digits are no disguise
    out, times = "", 1
    for token in _TOKEN.findall(m[0].lower()):
        if token in REPEATS:
            times = REPEATS[token]
        elif token == "plus":
            out += "+"
        else:
            out, times = out + DIGIT_WORDS.get(token, token) * times, 1
    return out


def _has_odd(text: str) -> bool:
    try:
        text.encode("latin-1")  # the map's only character of that set is the soft hyphen
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return "\u00ad" in text


def _spelled_evidence(low: str) -> bool:
    """Whether some digit word has a unit after it, or is preceded by a digit; one of a run of units must."""
    for word in DIGIT_WORDS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if not at or not (low[at - 1].isalnum() or low[at - 1] == "_"):
                if low[end : end + 1] in (" ", ",", "-") and _NEXT_UNIT.match(low, end):
                    return True
                before = at
                while before and low[before - 1] in " ,-":
                    before -= 1
                if before and low[before - 1] in "0123456789":
                    return True
            at = low.find(word, end)
    return False


def normalise(text: str) -> Tape | None:
    """The last tape of the cascade, or None where no transducer has anything to rewrite."""
    odd = _has_odd(text)
    low = text.lower()
    # each first test is one that the pattern's matches pass
    brackets = any(map(text.__contains__, "[({<")) and bool(_AT.search(text) or _DOT.search(text))
    dotted = " dot " in low and _DOT.search(text) is not None
    unsure = any(map(text.__contains__, _CASE_ODD))
    spelled = (unsure or _spelled_evidence(low)) and any(_DIGIT_WORD.search(m[0]) for m in _SPELLED.finditer(text))
    said = (" dot " in low or " at " in low and (unsure or _ENDING.search(low) is not None)) and _SAID.search(text) is not None
    if not (odd or brackets or dotted or spelled or said):
        return None
    tape = Tape(text.translate(_ONE_FOR_ONE) if odd else text)  # this keeps all places
    if odd:
        tape = tape.rewrite(_UNSEEN, lambda m: "")
    tape = tape.rewrite(_SPELLED, _digits)
    tape = tape.rewrite(_AT, lambda m: "@").rewrite(_DOT, lambda m: ".")
    # "name at host dot com" becomes an address in two steps, each of which keeps its offsets
    spans = [(m.start(), m.end()) for m in _SAID.finditer(tape.text)]
    for gap, sign in ((_GAP_DOT, "."), (_GAP_AT, "@")):
        if spans:
            own = [m.span() for s, e in spans for m in gap.finditer(tape.text, s, e)]
            at = dict(own)
            tape = tape.rewrite(gap, lambda m, at=at, sign=sign: sign if m.start() in at else m[0]) if own else tape
            spans = [(m.start(), m.end()) for m in _SAID.finditer(tape.text)]
    return tape if tape.text != text else None


_BARE = re.compile(r"(?<![0-9+])[0-9]{7,15}(?![0-9])")


def find_disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the normalised text shows and no plain span of their kind covers; those of one kind do not overlap."""
    tape = normalise(text)
    if tape is None:
        return []
    found = find_plain(tape.text)
    # a spelled number needs no plus sign: nobody spells other digits out one by one
    for m in _BARE.finditer(tape.text):
        low, high = tape.source(*m.span())
        if high - low >= 3 * (m.end() - m.start()):
            found.append(("phone", *m.span()))
    out = []
    for kind in KINDS:
        own = [(s, e) for k, s, e in plain if k == kind]
        floor = 0
        for low, high in sorted(tape.source(s, e) for k, s, e in found if k == kind):
            i = bisect_right(own, low, key=lambda x: x[0]) - 1
            if low >= floor and not (i >= 0 and high <= own[i][1]):
                out.append((kind, low, high))
                floor = high
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain, added = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            found = find_plain(text)
            more = find_disguised(text, found)
            plain.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            added.append([{"kind": k, "start": s, "end": e} for k, s, e in _ordered(found + more)] if more else plain[-1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(plain, _ARROW_SPANS), pa.array(added, _ARROW_SPANS)], names=["doc_id", "base", "spans"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base (plain spans) and spans (all), each by kind and start."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_detect, f"doc_id long, base {SPANS}, spans {SPANS}")


def redact_text(text: str) -> str:
    """The text with each span, or each union of overlapping spans, replaced by its kind in brackets."""
    plain = find_plain(text)
    spans = sorted((s, e, k) for k, s, e in plain + find_disguised(text, plain))
    out, last, label = [], 0, ""
    for s, e, kind in spans:
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; n_chars, where there is one, counts the new text. Null texts stay null."""
    at = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if (t := x.as_py()) is None else redact_text(t) for x in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    out = docs.mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
