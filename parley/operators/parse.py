"""From words, acts and transcripts to parsed rows: references, pipe boundaries, part times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORDS = "array<struct<text:string,kind:string,start:double,end:double>>"
HREF = r"^([^#]+)#id\(([^)]+)\)(?:\.\.id\(([^)]+)\))?\z"


def split_href(acts: DataFrame) -> DataFrame:
    """acts with file, first and last of href; ref is none, malformed or given."""
    part = lambda i: F.nullif(F.regexp_extract("href", HREF, i), F.lit(""))
    known = F.col("href").rlike(HREF)
    ref = F.when(F.col("href").isNull() | (F.col("href") == ""), "none").when(known, "given").otherwise("malformed")
    return acts.withColumns({"ref": ref, "file": F.when(known, part(1)), "first": T.lookup_id(part(2)), "last": T.lookup_id(F.coalesce(part(3), part(2)))})


def resolve_references(acts: DataFrame, words: DataFrame) -> DataFrame:
    """acts (with a unique act_id and split_href's columns) with words, their inclusive range in document order, and ref_flags.

    words: file, idx, norm_id, text, kind, start, end. Two equi joins find the ends, a third the words of each place between them.
    """
    ids = words.groupBy("file", "norm_id").agg(F.max("idx").alias("idx"))
    ends = acts.join(ids.select("file", F.col("norm_id").alias("first"), F.col("idx").alias("low")), ["file", "first"], "left")
    ends = ends.join(ids.select("file", F.col("norm_id").alias("last"), F.col("idx").alias("high")), ["file", "last"], "left")
    good = F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("low") <= F.col("high"))
    ends = ends.withColumn("resolved", F.coalesce(good, F.lit(False)))
    places = ends.filter("resolved").select("act_id", "file", F.explode(F.sequence("low", "high")).alias("idx"))
    inside = places.join(words, ["file", "idx"])
    lists = inside.groupBy("act_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "kind", "start", "end"))).alias("w"))
    got = ends.join(lists, "act_id", "left").withColumn("words", F.coalesce(F.transform("w", lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), F.expr(f"cast(array() as {WORDS})")))
    untimed = F.exists("words", lambda w: w["start"].isNull() | w["end"].isNull())
    flags = F.array_compact(F.array(
        F.when(F.col("ref") == "malformed", "ref_malformed"), F.when(F.col("ref") == "none", "no_word_ref"),
        F.when((F.col("ref") == "given") & ~F.col("resolved"), "ref_unresolved"), F.when(untimed, "word_time_missing"),
    ))
    return got.withColumn("ref_flags", flags).drop("w", "low", "high", "resolved")


def let(value: Column, f) -> Column:
    """f of a value that is computed once: inside a lambda function, anything but a lambda's variable is computed for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns whose values are computed once: the optimizer does not copy them into the expressions that use them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def lexical_text(words: str) -> Column:
    """The words' letters and digits in one text, and ends: its length after each number of words, from none to all."""
    lexical = F.transform(F.col(words), lambda w: F.coalesce(F.when(w["kind"] == "w", T.alignment_text(w["text"])), F.lit("")))
    ends = lambda lex: F.aggregate(lex, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    return let(lexical, lambda lex: F.struct(F.array_join(lex, "").alias("whole"), ends(lex).alias("ends")))


def pipe_boundaries(words: str, rendering: Column, parts: Column, lexical: Column | None = None) -> Column:
    """For each pipe of a rendering the count of words before it, null where the rendering does not align.

    The words' lexical text up to a boundary equals the rendering's up to the pipe, letters and digits only; of equal places the last counts. So the whole
    text begins with the rendering's, and a number of words ends there. lexical is lexical_text(words), where it is at hand.
    """

    def aligned(pieces):
        def place(said, prefix):
            ending = F.filter(F.transform(said["ends"], lambda e, i: F.when(e == F.length(prefix), i)), lambda i: i.isNotNull())
            return F.when(said["whole"].startswith(prefix), F.array_max(ending))

        prefixes = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda _, i: F.array_join(F.slice(pieces, F.lit(1), i + 1), ""))
        found = let(lexical_text(words) if lexical is None else lexical, lambda said: F.transform(prefixes, lambda p: let(p, lambda prefix: place(said, prefix))))
        ordered = lambda f: f == F.array_sort(f)
        fits = let(found, lambda f: F.when(~F.exists(f, lambda x: x.isNull()) & ordered(f), f))
        return F.when(F.size(pieces) == parts, fits)

    return let(F.transform(F.split(rendering, "[|]"), T.alignment_text), aligned)


def split_words(words: str, boundaries: Column, parts: Column) -> Column:
    """The words of each part, between boundaries."""
    ends = F.concat(F.array(F.lit(0)), boundaries, F.array(F.size(words)))
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(F.col(words), F.get(ends, i) + 1, F.get(ends, i + 1) - F.get(ends, i)))


def part_times(df: DataFrame, start: str = "src_start", end: str = "src_end", parts: str = "parts") -> DataFrame:
    """df with times (start and end of each part) and timing_method.

    A boundary is the end of the last word before it, else the start of the first word after it, clamped to stay in order within the
    act. If any boundary has neither, all follow from word counts, or are even without words.
    """
    df = bind(df, _parts=F.col(parts), _counts=F.transform(parts, F.size))
    n, counts = F.size("_counts"), F.col("_counts")
    inner = F.sequence(F.lit(0), n - 2)  # boundaries, if there are two parts at least
    edge = lambda i: F.coalesce(F.get(F.get("_parts", i), F.size(F.get("_parts", i)) - 1)["end"], F.get(F.get("_parts", i + 1), F.lit(0))["start"])
    none = F.expr("cast(array() as array<double>)")
    upto = lambda i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
    df = bind(df, _by_word=F.when(n > 1, F.transform(inner, edge)).otherwise(none), _total=F.aggregate(counts, F.lit(0), lambda a, x: a + x))
    shares = F.transform(inner, lambda i: F.when(F.col("_total") == 0, (i + 1) / n).otherwise(upto(i) / F.greatest("_total", F.lit(1))))
    df = bind(df, _timed=~F.exists("_by_word", lambda x: x.isNull()), _shares=F.when(n > 1, shares).otherwise(none))
    clamp = F.aggregate("_by_word", none, lambda a, x: F.concat(a, F.array(F.least(F.col(end), F.greatest(F.coalesce(F.get(a, F.size(a) - 1), F.col(start)), x)))))
    spread = F.transform("_shares", lambda s: F.col(start) + (F.col(end) - F.col(start)) * s)
    df = bind(df, _ends=F.concat(F.array(start), F.when(F.col("_timed"), clamp).otherwise(spread), F.array(end)))
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("_ends", i).alias("start"), F.get("_ends", i + 1).alias("end")))
    method = F.when(n == 1, "element").when(F.col("_timed"), "transcript_word_boundary").otherwise("transcript_proportional")
    return bind(df, times=times, timing_method=method).drop("_parts", "_counts", "_by_word", "_total", "_timed", "_shares", "_ends")


def act_types(acts: DataFrame) -> DataFrame:
    """acts with used_type (type, else original_type, else nothing) and type_flags; with times that are invalid or reversed flagged and set to 0."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    used = F.when(~empty("raw_type"), F.col("raw_type")).when(~empty("original_type"), F.col("original_type")).otherwise("")
    low, high = T.parse_time(F.col("start_raw")), T.parse_time(F.col("end_raw"))
    bad = F.coalesce(low.isNull() | high.isNull() | (low > high), F.lit(True))
    flags = F.array_compact(F.array(
        F.when(empty("raw_type") & ~empty("original_type"), "type_fallback_original"), F.when(empty("raw_type") & empty("original_type"), "type_unavailable"), F.when(bad, "time_invalid"),
    ))
    return acts.withColumns({"used_type": used, "type_flags": flags, "src_start": F.when(bad, 0.0).otherwise(low), "src_end": F.when(bad, 0.0).otherwise(high)})


def why_not(words: str, rendering: Column, parts: Column) -> Column:
    """Why pipe_boundaries finds none: other parts, other words, or words in another order."""
    lexical = F.array_join(F.transform(F.filter(F.col(words), lambda w: w["kind"] == "w"), lambda w: T.alignment_text(w["text"])), "")

    def reason(pieces):
        whole = let(lexical, lambda text: F.forall(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: text.startswith(F.array_join(F.slice(pieces, F.lit(1), i), ""))))
        other = F.when(whole, "a pipe falls inside a word").otherwise("other words")
        return F.when(F.size(pieces) != parts, F.format_string("%d parts instead of %d", F.size(pieces), parts)).otherwise(other)

    return let(F.transform(F.split(rendering, "[|]"), T.alignment_text), reason)


def locate(acts: DataFrame, words: DataFrame, transcripts: DataFrame) -> DataFrame:
    """acts with their words, transcript key, renderings, multi (several parts that need one) and boundaries, of the first rendering that aligns."""
    df = split_href(act_types(acts)).withColumn("act_id", F.concat_ws("|", "meeting", "agent", F.col("element_ordinal").cast("string")))
    df = df.withColumn("file", F.coalesce("file", F.concat(F.col("meeting"), F.lit("."), F.col("agent"), F.lit(".words.xml"))))
    df = resolve_references(df, words).withColumn("part_types", F.split("used_type", "[|]")).withColumn("n_parts", F.size("part_types"))
    bad_time = F.array_contains("type_flags", "time_invalid")
    df = df.withColumns({"ms0": F.when(~bad_time, T.milliseconds(F.col("start_raw"))), "ms1": F.when(~bad_time, T.milliseconds(F.col("end_raw")))})
    df = df.withColumn("key", T.transcript_key(F.col("meeting"), F.col("channel"), F.col("ms0"), F.col("ms1"))).join(transcripts, "key", "left")
    df = df.withColumns({"renderings": F.coalesce("renderings", F.expr("cast(array() as array<string>)")), "multi": (F.col("n_parts") > 1) & ~F.array_contains("ref_flags", "no_word_ref")})
    df = bind(df, _said=F.when(F.col("multi") & (F.size("renderings") > 0), lexical_text("words")))
    tried = F.filter(F.transform("renderings", lambda r: pipe_boundaries("words", r, F.col("n_parts"), F.col("_said"))), lambda x: x.isNotNull())
    return bind(df, boundaries=F.when(F.col("n_parts") == 1, F.expr("cast(array() as array<int>)")).when(F.col("multi"), F.get(tried, F.lit(0)))).drop("_said")


def transcript_problems(acts: DataFrame, words: DataFrame, transcripts: DataFrame) -> DataFrame:
    """source_da_id, reason and context of each act of several parts whose words no transcript divides: the key, and in order why each rendering failed."""
    lost = locate(acts, words, transcripts).filter("multi AND boundaries IS NULL")
    reason = F.when(F.size("renderings") == 0, "no rendering has pipes").otherwise("no rendering fits the words")
    key = F.when(F.array_contains("type_flags", "time_invalid"), "no valid time").otherwise(F.col("key"))
    why = F.array_join(F.transform("renderings", lambda r, i: F.concat((i + 1).cast("string"), F.lit(": "), why_not("words", r, F.col("n_parts")))), "; ")
    return lost.select(F.coalesce("source_da_id", F.lit("an act without an id")).alias("source_da_id"), reason.alias("reason"), F.concat_ws("; ", F.concat(F.lit("key "), key), F.format_string("%d renderings", F.size("renderings")), F.nullif(why, F.lit(""))).alias("context"))


def parse_rows(acts: DataFrame, words: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Parsed rows, see schemas.PARSED, positions included.

    acts: meeting, agent, element_ordinal, source_da_id, start_raw, end_raw, raw_type, original_type, channel, participant, adjacency_raw,
    comment, href. transcripts: key and renderings. Acts of several parts follow the first rendering that aligns with their words.
    """
    from .annotate import assign_positions

    df = locate(acts, words, transcripts)
    blank = F.expr(f"transform(sequence(1, n_parts), i -> cast(array() as {WORDS}))")
    df = bind(df, parts=F.when(F.col("boundaries").isNotNull(), split_words("words", F.col("boundaries"), F.col("n_parts"))).otherwise(blank))
    df = part_times(df)
    unaligned = F.col("multi") & F.col("boundaries").isNull()
    flags = F.array_distinct(F.concat("ref_flags", "type_flags", F.array_compact(F.array(F.when(unaligned, "ref_unresolved")))))
    df = df.withColumns({"quality_flags": flags, "timing_method": F.when((F.col("n_parts") > 1) & F.array_contains("ref_flags", "no_word_ref"), "source_proportional").otherwise(F.col("timing_method"))})
    rows = df.select("*", F.posexplode("part_types").alias("part_index", "part_type"))
    part = F.col("part_index")
    rows = rows.withColumns({"words": F.get("parts", part), "start": F.get("times", part)["start"], "end": F.get("times", part)["end"]})
    named = T.seg_id(F.col("meeting"), F.col("channel"), F.col("ms0"), F.col("ms1"), part, F.col("n_parts"))
    rows = rows.withColumns({"seg_id": F.when(F.array_contains("quality_flags", "time_invalid"), T.invalid_seg_id(F.col("meeting"), F.col("channel"), F.col("source_da_id"), part, F.col("n_parts"))).otherwise(named), "text": T.build_text(F.col("words")), "speaker_id": F.col("participant")})
    from ..schemas import PARSED

    names = [x.split(" ")[0] for x in PARSED.replace("array<struct<text:string,kind:string,start:double,end:double>>", "x").split(", ")]
    return assign_positions(rows).select(*names)
