"""Quality rules: fixed base rules, then robust multivariate outliers. DataFrame functions only.

Each text gives a vector of transformed statistics. For each language and source, each language, and everything, a minimum-covariance-
determinant estimate says where the bulk lies: from three starts (spreads alone, correlations of tanh scores, and of spatial signs)
concentration steps take the mean and covariance of the share SUPPORT of rows with the least Mahalanobis distance so far. After two steps the
start with the least determinant goes on, until the determinant settles; a step that would enlarge it is not taken. The estimate is then
reweighted: mean and covariance of all rows within the REWEIGHT distance.

Small groups: the mean and inverse covariance from n rows have the weight n / (n + PRIOR_ROWS) and those of the next wider group the rest, so a
language and source is drawn to its language, and that to everything, the more the fewer rows it has. This holds for every group alike: one junk row is no bulk of its own, and
groups of thousands decide for themselves. Rows whose distance from their group's estimate exceeds the cutoff are rejected.

A row's distance is known by its bin, BINS to each doubling. One aggregation a step gives count and moments by group, start and bin; bins
are taken in order, and of the last one only the part that the share needs. No group is collected or sorted, every aggregate combines
before its shuffle, and the results do not depend on how rows are dealt out.

Defined results: a null text has no words, hence fails the base rules; null languages and sources are groups of their own; repeated
rows each get their own row; rows that fail the base rules are no part of any estimate; a table without other rows has no estimate and no
distances; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, materialize, skew_join, table, text_or_empty

LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, per cent of words in repeated windows
SUPPORT, STARTS, TRIAL_STEPS, SETTLED = 0.75, 3, 2, 0.005
PRIOR_ROWS = 50  # ten for each feature
BINS = 16  # distance bins to each doubling
FEATURES = ("f_length", "f_symbol", "f_upper", "f_lines", "f_repeat")
P = len(FEATURES)
#: Standard deviations added to each feature's own, set by hand: most texts have no symbol and repeat nothing, and where the central rows are alike
#: no covariance could be inverted. For symbols, repeated lines and repeated words the central rows of clean text have no spread at all, so that these
#: floors, and not an estimate, decide how far such a text may be from its group; for length and capitals they are about as large as the estimates.
FLOORS = (0.03, 0.05, 0.03, 0.05, 0.06)
#: The 0.9999999 and 0.975 quantiles of the chi-squared distribution with five degrees of freedom.
CUTOFF, REWEIGHT = 40.863, 12.8325
#: Make the covariances of the central 0.75 and 0.975 of a normal distribution in five dimensions consistent.
CONSISTENCY, REWEIGHTED = 1.412, 1.0555


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper of each text.

    Each step is a projection of its own, because a lambda function evaluates what it refers to again for each element.
    """
    df = docs.select(*keep, text_or_empty().alias("t")).select("*", F.btrim("t", F.lit(SPACE)).alias("trimmed"))
    df = df.select(
        *keep,
        F.when(F.col("trimmed") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("trimmed", SPACE_CLASS + "+")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    df = df.select(
        *keep, "words", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.ceil(F.log2(F.size("words") + 1)).cast("int").alias("bits"),
        F.expr("CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").alias("hashes"),
    )
    plain = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper"]
    # Window hashes shortened to leave room for the position; sorting brings windows that may be equal together.
    df = df.select(*plain, "words", "bits", F.expr("CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN sort_array(transform(hashes, (h, i) -> shiftleft(h, bits) | cast(i AS bigint))) ELSE array() END").alias("packed"))
    df = df.select(*plain, "words", "bits", F.expr("""filter(packed, (v, i) -> shiftright(v, bits) = shiftright(get(packed, i - 1), bits) OR shiftright(v, bits) = shiftright(get(packed, i + 1), bits))""").alias("near"))
    # The windows themselves decide.
    df = df.select(*plain, "words", F.expr("transform(near, v -> cast(v & (shiftleft(1L, bits) - 1) AS int))").alias("places"))
    df = df.select(*plain, F.expr("array_sort(transform(places, p -> struct(words[p] AS a, words[p + 1] AS b, words[p + 2] AS c, p AS p)))").alias("windows"))
    same = "({0}.a = {1}.a AND {0}.b = {1}.b AND {0}.c = {1}.c)"
    df = df.select(*plain, F.expr(f"array_sort(transform(filter(windows, (w, i) -> coalesce({same.format('w', 'get(windows, i - 1)')}, false) OR coalesce({same.format('w', 'get(windows, i + 1)')}, false)), w -> w.p))").alias("starts"))
    covered = F.expr("aggregate(transform(starts, (p, i) -> least(3, coalesce(get(starts, i + 1) - p, 3))), 0L, (s, x) -> s + x)")
    return df.select(*plain, covered.alias("n_repeat_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """Ratios on scales where the bulk of a group is roughly symmetric; counts are padded so that short texts do not stand out."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.select(
        "*",
        F.log((chars + 50) / (n + 10)).alias("f_length"),
        F.log1p(20 * F.col("n_symbols") / (chars + 50)).alias("f_symbol"),
        F.log1p(10 * F.col("n_upper") / (chars + 50)).alias("f_upper"),
        F.log1p(4 * F.col("n_dup_lines") / (F.col("n_lines") + 5)).alias("f_lines"),
        F.log1p(4 * F.col("n_repeat_words") / (n + 50)).alias("f_repeat"),
    )


#: The inverse of a positive definite matrix a of P rows (an array by rows) and the logarithm of its determinant, by Gauss-Jordan steps without pivoting.
INVERSE = """aggregate(sequence(0, P - 1), named_struct('a', a, 'logdet', 0.0D), (z, k) -> named_struct('a', transform(sequence(0, P * P - 1), t -> CASE
    WHEN t = k * (P + 1) THEN 1 / z.a[k * (P + 1)]
    WHEN cast(t div P AS int) = k THEN z.a[t] / z.a[k * (P + 1)]
    WHEN t % P = k THEN -z.a[t] / z.a[k * (P + 1)]
    ELSE z.a[t] - z.a[cast(t div P AS int) * P + k] * z.a[k * P + t % P] / z.a[k * (P + 1)] END), 'logdet', z.logdet + ln(z.a[k * (P + 1)])))""".replace("P", str(P))
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _inverted(df: DataFrame) -> DataFrame:
    """df with precision and logdet of its covariance a."""
    found = df.withColumn("inverse", F.expr(INVERSE))
    return found.select(*df.columns, F.col("inverse.a").alias("precision"), F.col("inverse.logdet").alias("logdet"))


def _matrix(entry) -> Column:
    """The array by rows of a symmetric matrix; entry(i, j) is called with i <= j."""
    return F.array(*[entry(min(i, j), max(i, j)) for i in range(P) for j in range(P)])


def _floor(i: int, j: int) -> float:
    return FLOORS[i] ** 2 if i == j else 0.0


def _centred(df: DataFrame) -> DataFrame:
    """df with x0 .. (FEATURES less mean) and d2, their squared Mahalanobis distance under precision, instead of FEATURES, mean and precision."""
    kept = [c for c in df.columns if c not in (*FEATURES, "mean", "precision")]
    df = df.select(*kept, "precision", *[(F.col(f) - F.col("mean")[i]).alias(f"x{i}") for i, f in enumerate(FEATURES)])
    terms = [f"{1 if i == j else 2} * precision[{i * P + j}] * x{i} * x{j}" for i, j in PAIRS]
    return df.select(*kept, *[f"x{i}" for i in range(P)], F.expr(" + ".join(terms)).alias("d2"))


def _moments() -> list[Column]:
    """Count, sums and sums of products of x0 .."""
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i, j in PAIRS]]


def _refined(sums: DataFrame, old: DataFrame, keys: list[str], factor: float, *more: str) -> DataFrame:
    """keys, more, mean and covariance a from sums (n, s0 .., p00 ..) of rows that were centred at old's mean."""
    over = lambda x: F.col(x) / F.col("n")
    found = sums.join(old.select(*keys, F.col("mean").alias("from")), keys)
    mean = F.array(*[F.col("from")[i] + over(f"s{i}") for i in range(P)])
    a = _matrix(lambda i, j: (over(f"p{i}{j}") - over(f"s{i}") * over(f"s{j}")) * factor + F.lit(_floor(i, j)))
    return found.select(*keys, *more, mean.alias("mean"), a.alias("a"))


def _quantiles(counts: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """counts: keys, bin, n. For each of keys the least bin with at least each share of the rows at or below it, as q0, q1 .."""
    w = Window.partitionBy(*keys)  # over bins, whose number does not grow with the rows
    ranked = counts.select(*keys, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bin"))).alias(f"q{i}") for i, share in enumerate(shares)])


def _centres(rows: DataFrame) -> DataFrame:
    """g, mean (coordinatewise medians) and scale (from quartiles, and floors), counted in bins of a 256th."""
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f) * 256).cast("int") for f in FEATURES])).alias("f", "bin"))
    found = _quantiles(long.groupBy("g", "f", "bin").agg(F.count(F.lit(1)).alias("n")), ["g", "f"], (0.25, 0.5, 0.75))
    spread, floors = (F.col("q2") - F.col("q0")) / 256 / 1.349, F.array(*map(F.lit, FLOORS))
    scale = F.sqrt(spread * spread + floors[F.col("f")] * floors[F.col("f")])
    of = lambda x, name: F.array(*[F.max(F.when(F.col("f") == i, x)) for i in range(P)]).alias(name)
    return found.groupBy("g").agg(of((F.col("q1") + 0.5) / 256, "mean"), of(scale, "scale"))


def _starts(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """g, start, mean, a: the covariances of three starts around the medians."""
    z = skew_join(rows, centres, ["g"], "inner").select("g", *[((F.col(f) - F.col("mean")[i]) / F.col("scale")[i]).alias(f"z{i}") for i, f in enumerate(FEATURES)])
    size = F.greatest(F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(P))), F.lit(1e-9))
    z = z.select("g", size.alias("size"), *[F.col(f"z{i}") for i in range(P)], *[F.tanh(f"z{i}").alias(f"t{i}") for i in range(P)])
    average = [F.avg(f"t{i}").alias(f"t{i}") for i in range(P)] + [F.avg(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"t{i}{j}") for i, j in PAIRS]
    average += [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("size") * F.col("size"))).alias(f"u{i}{j}") for i, j in PAIRS]
    found = z.groupBy("g").agg(*average).join(centres, "g")
    ridge = lambda i, j: 0.05 if i == j else 0.0
    scaled = lambda entry: _matrix(lambda i, j: F.col("scale")[i] * F.col("scale")[j] * entry(i, j))
    shapes = [scaled(lambda i, j: F.lit(float(i == j))), scaled(lambda i, j: F.col(f"t{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}") + ridge(i, j)), scaled(lambda i, j: F.col(f"u{i}{j}") + ridge(i, j))]
    return found.select("g", F.posexplode(F.array(*shapes)).alias("start", "a"), "mean").select("g", "start", "mean", "a")


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: rows (g, FEATURES), estimate (g, start, mean, a, precision, logdet). The result has n and settled too."""
    near = _centred(skew_join(rows, estimate.select("g", "start", "mean", "precision"), ["g"], "inner"))
    binned = near.groupBy("g", "start", F.floor(F.log2(F.col("d2") + 1e-6) * BINS).cast("int").alias("bin")).agg(*_moments())
    w = Window.partitionBy("g", "start")  # over bins
    ranked = binned.select("*", (F.sum("n").over(w.orderBy("bin")) - F.col("n")).alias("below"), F.sum("n").over(w).alias("total"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ceil(SUPPORT * F.col("total")) - F.col("below")) / F.col("n")))
    names = ["n", *[f"s{i}" for i in range(P)], *[f"p{i}{j}" for i, j in PAIRS]]
    sums = ranked.select("g", "start", "total", share.alias("share"), *names).groupBy("g", "start").agg(F.max("total").alias("total"), *[F.sum(F.col("share") * F.col(x)).alias(x) for x in names])
    new = _inverted(_refined(sums, estimate, ["g", "start"], 1.0, "total"))
    both = new.join(estimate.select("g", "start", *[F.col(x).alias(f"old_{x}") for x in ("mean", "a", "precision", "logdet")]), ["g", "start"])
    worse = F.col("logdet") > F.col("old_logdet")
    pick = lambda x: F.when(worse, F.col(f"old_{x}")).otherwise(F.col(x)).alias(x)
    return both.select("g", "start", F.col("total").alias("n"), *map(pick, ("mean", "a", "precision", "logdet")), (F.col("logdet") > F.col("old_logdet") - SETTLED).alias("settled"))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """g, n, mean and precision: the reweighted estimate of each group of rows (g, FEATURES). One small table is written for each concentration step."""
    # the first step is compared with nothing: its start covers other rows than a share
    estimate = materialize(_inverted(_starts(rows, materialize(_centres(rows), "centres"))).withColumn("logdet", F.lit(float("inf"))), "estimates")
    for _ in range(TRIAL_STEPS):
        estimate = materialize(_concentrated(rows, estimate), "estimates")
    first = Window.partitionBy("g").orderBy("logdet", "start")  # STARTS rows
    now = estimate.select("*", F.row_number().over(first).alias("rank")).filter("rank = 1").drop("rank")
    done = []
    while True:
        now = materialize(_concentrated(rows, now), "estimates")
        done.append(now.filter("settled"))
        now = now.filter("NOT settled")
        if not now.limit(1).count():
            break
    found = done[0]
    for df in done[1:]:
        found = found.unionByName(df)
    wide = F.zip_with("a", _matrix(lambda i, j: F.lit(_floor(i, j))), lambda x, floor: (x - floor) * CONSISTENCY + floor)
    found = materialize(_inverted(found.select("g", "n", "mean", wide.alias("a"))), "estimates")
    near = _centred(skew_join(rows, found.select("g", "mean", "precision"), ["g"], "inner")).filter(F.col("d2") <= REWEIGHT)
    again = _refined(near.groupBy("g").agg(*_moments()), found, ["g"], REWEIGHTED).select("g", F.col("mean").alias("new_mean"), F.col("a").alias("new_a"))
    out = found.join(again, "g", "left")
    return materialize(_inverted(out.select("g", "n", F.coalesce("new_mean", "mean").alias("mean"), F.coalesce("new_a", "a").alias("a"))).select("g", "n", "mean", "precision"), "estimates")


def _blended(own: str, wider: str) -> list[Column]:
    """The columns mean and precision of own, drawn to those of wider (structs of n, mean, precision)."""
    weight = F.col(f"{own}.n") / (F.col(f"{own}.n") + PRIOR_ROWS)
    return [F.zip_with(f"{own}.{x}", f"{wider}.{x}", lambda p, q: p * weight + q * (1 - weight)).alias(x) for x in ("mean", "precision")]


def _judges(groups: DataFrame, estimate: DataFrame) -> DataFrame:
    """own, mean, precision: the estimate by which each language and source is judged."""
    named = lambda name, key: estimate.select(F.col("g").alias(key), F.struct("n", "mean", "precision").alias(name))
    df = groups.join(named("o", "own"), "own").join(named("l", "language"), "language")
    df = df.crossJoin(F.broadcast(estimate.filter(f"g = {EVERYTHING}").select(F.struct("n", "mean", "precision").alias("e"))))  # one row
    df = df.select("own", "o", F.struct(F.col("l.n").alias("n"), *_blended("l", "e")).alias("l"))
    return df.select("own", *_blended("o", "l"))


EVERYTHING = -1


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, content (xxhash64 of the text), lang, source, the statistics, base_failed, distance (null where nothing was estimated) and kept."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "lang", "source", "text")
    pairs = source.select("lang", "source").distinct().withColumn("own", F.monotonically_increasing_id())
    pairs = materialize(pairs, "groups")
    # groups are numbers: from 0 on a language and source, from -2 down a language
    langs = pairs.groupBy(F.col("lang").alias("l")).agg((-2 - F.min("own")).alias("language"))
    groups = materialize(pairs.join(langs, F.col("lang").eqNullSafe(F.col("l"))).select(F.col("lang").alias("l"), F.col("source").alias("s"), "own", "language"), "groups")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = with_features(text_statistics(source, "doc_id", "content", "lang", "source")).withColumn("base_failed", failed)
    stats = stats.join(groups, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    stats = materialize(stats, "statistics")
    levels = F.explode(F.array("own", "language", F.lit(EVERYTHING).cast("long"))).alias("g")
    estimate = minimum_covariance(stats.filter(~F.col("base_failed")).select(levels, *FEATURES))
    judges = materialize(_judges(groups.select("own", "language"), estimate), "estimates")
    joined = skew_join(stats.drop("language"), judges, ["own"])
    near = _centred(joined.select("*", *[F.col(f).alias(f"{f}_") for f in FEATURES]))
    judged = near.drop(*[f"x{i}" for i in range(P)]).withColumnsRenamed({f"{f}_": f for f in FEATURES})
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select("*", distance.alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))).alias("kept")).drop("own", "d2")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
