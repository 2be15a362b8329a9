"""Tolerant as-of join: for each probe the latest event of its key at or before it, no older than a tolerance.

Probes and events become one table in order of key and time, dealt out by ranges of (key, time), so that a key with a third of all rows
spreads over as many tasks as its rows need. Consecutive rows form slices of SLICE_ROWS. Within a slice and key, a window with the
RANGE frame from tolerance microseconds before a row up to it takes the greatest packed struct (time, tie keys, payload). What
lies before the slice enters as one carried row, the greatest struct of the key's earlier slices: no other can win, since the struct begins with
the time. Carried rows come from windows over slices of a part, and over parts of a key, whose rows are aggregates. How many events share the
matched time is counted by an aggregate and joined afterwards.

Defined results: a null key or time never matches and events without one are left out; of equal times the greatest tie keys win, null loses
to all; repeated probes each get a row, repeated events are one match and count each; an empty side gives no match or no row; a tolerance of 0
matches equal times only; columns of the two sides may have the same names, since only the probe's and the named ones come back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, skew_join, table

SLICE_ROWS = 64  # a frame is evaluated row by row, so that its cost is that of its length
PART_BITS, SLICE_BITS = 33, 6  # of monotonically_increasing_id: the part's number is above 33 bits
HOUR_US = 3_600_000_000


def asof_join(probes: DataFrame, events: DataFrame, key: str, at: str, tolerance: int, ties: Mapping[str, Column], payload: Mapping[str, Column], count: str = "n_tied") -> DataFrame:
    """probes with the payload of their match, matched_at and the number of the key's events at that time; nulls and 0 where there is none.

    key and at (a long, such as microseconds) are columns of both sides. ties: columns of events of which the greatest wins, first one first; payload: columns
    of events to bring back, by their new names, which decide what ties leave open.
    """
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    event = F.struct(F.col(at).alias("at"), *[c.alias(f"tie_{n}") for n, c in ties.items()], *[c.alias(f"get_{n}") for n, c in payload.items()])
    ordered = events.filter(known).select(F.col(key).alias("k"), F.col(at).cast("long").alias("t"), event.alias("event"))
    asked = probes.filter(known).select(F.col(key).alias("k"), F.col(at).cast("long").alias("t"), F.struct("*").alias("probe"))
    # events come before probes of the same time; the hash lets many rows of one time spread over parts
    both = ordered.withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    spread = both.withColumn("h", F.xxhash64("event", "probe")).repartitionByRange("k", "t", "side", "h").sortWithinPartitions("k", "t", "side")
    rows = materialize(spread.drop("h", "side").withColumn("row", F.monotonically_increasing_id()), "asof")
    rows = rows.withColumns({"part": F.shiftrightunsigned("row", PART_BITS), "slice": F.shiftrightunsigned("row", SLICE_BITS)})
    best = rows.groupBy("k", "part", "slice").agg(F.max("event").alias("event"))
    before = lambda *by: F.max("event").over(Window.partitionBy(*by).orderBy("part", "slice").rowsBetween(Window.unboundedPreceding, -1))
    in_part = best.withColumn("inner", before("k", "part"))
    parts = rows.groupBy("k", "part").agg(F.max("event").alias("event"), F.min("slice").alias("slice")).withColumn("outer", before("k")).filter("outer IS NOT NULL")
    carried = skew_join(in_part.drop("event"), parts.select("k", "part", "outer"), ["k", "part"]).select("k", "slice", F.greatest("inner", "outer").alias("event")).filter("event IS NOT NULL")
    # greatest skips nulls; the later of both is the one that counts
    entries = rows.select("k", "slice", "t", "event", "probe").unionByName(carried.withColumn("t", F.col("event.at")), allowMissingColumns=True)
    frame = Window.partitionBy("k", "slice").orderBy("t").rangeBetween(-tolerance, Window.currentRow)
    found = entries.withColumn("found", F.max("event").over(frame)).filter("probe IS NOT NULL").select("k", F.col("found.at").alias("m"), "probe", "found")
    tied = ordered.groupBy("k", F.col("t").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    matched = skew_join(found.filter("m IS NOT NULL"), tied, ["k", "m"])
    names = [F.col("probe")[c].alias(c) for c in probes.columns]
    got = [F.col("found")[f"get_{n}"].alias(n) for n in payload]
    out = matched.select(*names, *got, F.col("m").alias("matched_at"), F.col("n").alias(count))
    return out.unionByName(found.filter("m IS NULL").select(*names), allowMissingColumns=True).unionByName(probes.filter(~known), allowMissingColumns=True).withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    local = F.col(ts).cast("timestamp_ntz")
    days = F.date_diff(F.to_date(local), F.lit("1970-01-01")).cast("long")
    return (days * 24 + F.hour(local)) * HOUR_US + F.minute(local).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("long")


def shop_times(df: DataFrame, id_: str, ts: str) -> DataFrame:
    """df with h, the crc32 of the id's digits, and ts_us, floored to the hour where h is odd."""
    us = micros(ts)
    return df.withColumn("h", F.crc32(F.col(id_).cast("string"))).withColumn("ts_us", F.when(F.col("h") % 2 == 1, us - F.pmod(us, F.lit(HOUR_US))).otherwise(us))


def op12_asof_join(spark, sf_dir: str) -> DataFrame:
    clicks, sales = table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales")
    # copies of a click agree; if they did not, the latest would count
    probes = shop_times(clicks, "click_id", "ts").groupBy("click_id").agg(F.max(F.struct("ts_us", "client_id")).alias("c")).select("click_id", "c.client_id", "c.ts_us")
    cents = F.floor(F.nanvl("total", F.lit(None).cast("double")) * 100 + 0.5)
    own = shop_times(sales, "sale_id", "sold_at").select("client_id", "ts_us", "sale_id", "priority", cents.cast("long").alias("total_cents"), "h")
    copies = F.array(F.struct("sale_id", "priority"), F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority")))
    both = own.select("client_id", "ts_us", "total_cents", F.inline(F.slice(copies, F.lit(1), F.when(F.col("h") % 3 != 0, 2).otherwise(1))))
    got = {c: F.col(c) for c in ("sale_id", "total_cents")}
    out = asof_join(probes, both, "client_id", "ts_us", 240 * HOUR_US, {"priority": -F.col("priority"), "sale_id": F.col("sale_id")}, got)
    return out.select("click_id", "client_id", "ts_us", "sale_id", (F.col("ts_us") - F.col("matched_at")).alias("lag_us"), "total_cents", "n_tied")


def _crc(x: str) -> str:
    digits = f"list_transform(string_split({x}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: xor(c >> 8, crc_table[(xor(c & 255, b) + 1)::INT])), 4294967295::BIGINT)"


OP12_SQL = f"""WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
c AS (SELECT DISTINCT click_id, client_id, epoch_us(ts) AS us, {_crc('click_id')} AS h FROM clicks, bits),
p AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us // 3600000000 * 3600000000 ELSE us END AS ts_us FROM c),
s AS (SELECT sale_id, client_id, priority, floor(100 * total + 0.5)::BIGINT AS total_cents, epoch_us(sold_at) AS us, {_crc('sale_id')} AS h FROM sales, bits),
f AS (SELECT * REPLACE (CASE WHEN h % 2 = 1 THEN us // 3600000000 * 3600000000 ELSE us END AS us) FROM s WHERE client_id IS NOT NULL AND us IS NOT NULL),
o AS (SELECT client_id, us, sale_id, priority, total_cents FROM f UNION ALL SELECT client_id, us, -1 - sale_id, 6 - priority, total_cents FROM f WHERE h % 3 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY client_id, us ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST) AS r, count(*) OVER (PARTITION BY client_id, us) AS n FROM o),
j AS (SELECT p.*, b.us, b.sale_id, b.total_cents, b.n FROM p ASOF LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON p.client_id = b.client_id AND p.ts_us >= b.us)
SELECT click_id, client_id, ts_us, CASE WHEN ok THEN sale_id END AS sale_id, CASE WHEN ok THEN ts_us - us END AS lag_us, CASE WHEN ok THEN total_cents END AS total_cents, CASE WHEN ok THEN n ELSE 0 END AS n_tied
FROM (SELECT *, coalesce(ts_us - us <= 864000000000, false) AS ok FROM j)"""
