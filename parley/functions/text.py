"""Scalar functions on annotation text, ids and times. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LABELS, MARKERS, PRECEDENCE, RAW_TAGS, TARGETS


def local_name(tag: Column) -> Column:
    """A tag without its {namespace}."""
    return F.element_at(F.split(tag, "[}]"), -1)


def strip(text: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_text(text: Column, description: Column) -> Column:
    """The trimmed text, else the description, else nothing."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), description, F.lit(""))


def lookup_id(raw: Column) -> Column:
    """An id without commas, as references use it."""
    return F.replace(raw, F.lit(","), F.lit(""))


def parse_time(raw: Column) -> Column:
    """Seconds as a double, null where blank or no number; a Java suffix such as 1.5d is no number."""
    number = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*\z"
    clean = strip(raw)
    plain = F.when(F.lower(clean).rlike(r"^[+-]?inf$"), F.concat(clean, F.lit("inity"))).otherwise(clean)
    return F.when(raw.rlike(number), plain.try_cast("double"))


def milliseconds(raw: Column) -> Column:
    """Source time as whole milliseconds, exactly; an error where it is finer or no number."""
    exact = strip(raw).try_cast("decimal(38,18)") * 1000
    fine = exact.isNull() | (exact != F.floor(exact))
    return F.when(raw.isNotNull(), F.when(fine, F.raise_error(F.concat(F.lit("not in whole milliseconds: "), raw)).cast("bigint")).otherwise(exact.cast("bigint")))


def seg_id(meeting: Column, channel: Column, start_ms: Column, end_ms: Column, part: Column, parts: Column) -> Column:
    base = F.format_string("%s-%s_%07d_%07d", meeting, channel, start_ms.cast("bigint"), end_ms.cast("bigint"))
    return F.concat(base, F.when(parts > 1, F.concat(F.lit("_p"), (part + 1).cast("string"))).otherwise(F.lit("")))


def invalid_seg_id(meeting: Column, channel: Column, source_id: Column, part: Column, parts: Column) -> Column:
    base = F.concat(meeting, F.lit("-"), channel, F.lit("_invalid_"), source_id)
    return F.concat(base, F.when(parts > 1, F.concat(F.lit("_p"), (part + 1).cast("string"))).otherwise(F.lit("")))


def transcript_key(meeting: Column, channel: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.format_string("%s-%s_%07d_%07d", meeting, F.regexp_replace(F.lower(channel), "^2c", "c"), start_ms.cast("bigint"), end_ms.cast("bigint"))


def alignment_text(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def build_text(words: Column) -> Column:
    return F.array_join(F.filter(F.transform(words, lambda w: w["text"]), lambda t: t != ""), " ")


def part_tokens(part_type: Column) -> Column:
    """Tags of a part: what stands before the first colon, split at ^ and dots."""
    return F.filter(F.split(F.substring_index(F.coalesce(part_type, F.lit("")), ":", 1), r"[\^.]"), lambda t: t != "")


def raw_label(tag: Column) -> Column:
    """The label of one raw tag, other by default."""
    known = F.create_map(*[F.lit(x) for pair in RAW_TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tag), F.lit("other"))


def target_tags(tokens: Column, merge_b: bool = False) -> Column:
    """Labels that tokens map to, distinct and in order of the label list."""
    raw = {label: [t for t, x in RAW_TAGS.items() if x == label] + (["b"] if merge_b and label == "bk" else []) for label in TARGETS}
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, raw[x]))), F.lit(x)) for x in TARGETS]))


def pick_label(targets: Column) -> Column:
    """The target of the highest precedence, else other."""
    return F.coalesce(*[F.when(F.array_contains(targets, x), F.lit(x)) for x in PRECEDENCE], F.lit("other"))


def general_tags(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*RAW_TAGS, *MARKERS)))


def disruption_markers(tokens: Column) -> Column:
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(*MARKERS)))


def label_index(label: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, LABELS)), label) - 1).cast("int")


ADJACENCY = r"(?U)^(\d+)(_*)([ab])(?:-(\d+))?(\+*)\z"


def adjacency_token(piece: Column) -> Column:
    """(number, underscores, side, speaker, plus) of one piece, null where it is malformed; speaker is null where none is given."""
    part = lambda i: F.regexp_extract(piece, ADJACENCY, i)
    token = F.struct(
        part(1).cast("int").alias("number"), F.length(part(2)).alias("underscores"), part(3).alias("side"),
        F.nullif(part(4), F.lit("")).cast("int").alias("speaker"), F.length(part(5)).alias("plus"),
    )
    return F.when(piece.rlike(ADJACENCY), token)


def adjacency_pieces(raw: Column) -> Column:
    return F.coalesce(F.split(raw, "[.]"), F.expr("cast(array() as array<string>)"))


def window_letter(index: Column) -> Column:
    """A to Z, then AA, AB and on: speakers by order of appearance. index counts from 0, up to a 32-bit integer's greatest."""
    start = F.struct(F.lit("").alias("name"), (index.cast("bigint") + 1).alias("left"))
    letter = lambda z: F.concat(F.chr(65 + (z["left"] - 1) % 26), z["name"])
    step = lambda z, _: F.when(z["left"] > 0, F.struct(letter(z).alias("name"), F.floor((z["left"] - 1) / 26).alias("left"))).otherwise(z)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda z: z["name"])  # 26 ** 7 is over 2 ** 32


def distance_bucket(distance: Column) -> Column:
    return F.when(distance.isNull(), "none").when(distance <= 5, "<=5").when(distance <= 10, "<=10").when(distance <= 50, "<=50").otherwise(">50")


def series(meeting: Column) -> Column:
    return F.regexp_extract(meeting, "^[A-Za-z]+", 0)


def render_context(left: Column, target: Column, right: Column, sep: str = " [SEP] ", opening: str = "", closing: str = "", suffix: str = "") -> Column:
    """left and right are closest first; the text reads in stream order."""
    return F.concat(F.array_join(F.concat(F.reverse(left), F.array(F.concat(F.lit(opening), target, F.lit(closing))), right), sep), F.lit(suffix))


def acceptable_responses(chains: Column, responders: str = "all", segments: str = "first", status: Column | None = None) -> Column:
    """Segments that count as an answer: of all chains or the first, their first segments or any.

    With a status, a link that is neither ok nor no_pair, whose status and chains disagree, or whose chains hold a null or an empty id, is an error at run time.
    """
    if responders not in ("all", "first") or segments not in ("first", "any"):
        raise ValueError("responders is all or first, segments is first or any")
    if status is not None:
        hole = F.exists(chains, lambda c: c.isNull() | F.exists(c, lambda s: s.isNull() | (s == "")))
        odd = F.when(~F.coalesce(status.isin("ok", "no_pair"), F.lit(False)), F.concat(F.lit("no gold in a link that is "), F.coalesce(status, F.lit("null")))).when(chains.isNull() | F.coalesce(hole, F.lit(True)), "a chain holds no id").when((status == "ok") != (F.size(chains) > 0), F.concat(F.lit("chains do not fit the status "), status))
        chains = F.when(odd.isNull(), chains).otherwise(F.raise_error(odd).cast("array<array<string>>"))
    used = chains if responders == "all" else F.slice(chains, 1, 1)
    return F.array_distinct(F.transform(used, lambda c: F.get(c, F.lit(0))) if segments == "first" else F.flatten(used))
