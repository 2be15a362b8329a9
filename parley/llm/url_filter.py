"""URL allow and block lists as one trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and all subdomains where the url's path starts with the rule's path. Of
the rules that fit, the longest (host and path together, then the longer host, then block before allow) decides. A walk
reads the host's labels from the last to the first and, at each host that ends a rule, the path's segments; rules that end within a segment
are looked up by each length that such rules have, at most the segment's own. So the cost depends on the url, not on the number of rules.

The trie is broadcast while it takes at most BROADCAST_BYTES as built, reckoned node by node as if rules shared none. Larger lists, and lists
that come as a DataFrame, are not broadcast: urls meet them in equi joins on (host suffix, path), see filter_by_join. Both ways give the same.

Defined results: a null url, or one with no "://", has host and path empty and no rule; without a rule the verdict is the
default; repeated rows each get their own row, repeated rules count once; urls and rules of any length are compared whole; an empty table
gives an empty table, an empty list no rule; other columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, table

BROADCAST_BYTES = 64 << 20
NODE_BYTES, RULE_BYTES = 320, 400  # a dict of one entry with its key; a rule's tuples and strings
#: The five rules of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(CAPITALS, SMALL)
NO_RULES: tuple[dict, list] = ({}, [])


class Trie:
    """Nodes are dicts. Host nodes hold labels; under the key "/" is the root of a host's paths.

    A path node holds whole segments; under the key "" are its rules by the rest of their path, which has no slash, and the lengths of these rests.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.setdefault("." + label, {})
            node = node.setdefault("/", {})
            *segments, rest = path.split("/")
            for segment in segments:
                node = node.setdefault("/" + segment, {})
            by_rest, lengths = node.setdefault("", ({}, []))
            rule = (len(host) + len(path), len(host), verdict == "block", verdict, host + path)
            by_rest[rest] = max(rule, by_rest.get(rest, rule))
            if len(rest) not in lengths:
                insort(lengths, len(rest))

    def match(self, host: str, path: str) -> tuple | None:
        """The deciding rule's (length, host length, is block, verdict, text), or None."""
        best, node = None, self.root
        segments = None
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.get("." + label)
                if node is None:
                    break
            if (at := node.get("/")) is not None:
                segments = path.split("/") if segments is None else segments
                for i, segment in enumerate(segments):
                    by_rest, lengths = at.get("", NO_RULES)
                    for n in reversed(lengths):  # of one node the longest rest that fits decides
                        if n <= len(segment) and (rule := by_rest.get(segment[:n])) is not None:
                            best = rule if best is None else max(best, rule)
                            break
                    at = at.get("/" + segment) if i + 1 < len(segments) else None
                    if at is None:
                        break
        return best


def _parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: text after the first "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    ascii_lower = F.translate(host, CAPITALS, SMALL)
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(path, F.lit(""))


def trie_bytes(rules: Iterable[tuple[str, str, str]]) -> int:
    """What a trie of these rules takes at most: each label and segment is a node."""
    return sum(NODE_BYTES * (h.count(".") + p.count("/") + 2) + RULE_BYTES + 2 * (len(h) + len(p)) for _, h, p in rules)


RULE = "verdict string, host string, path string"


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages (page_id, url). rules: (verdict, host, path) each, or a table of these."""
    spark = pages.sparkSession
    host, path = _parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        return filter_by_join(parts, rules, default)
    rules = list(rules)
    if trie_bytes(rules) > broadcast_bytes:
        return filter_by_join(parts, spark.createDataFrame(rules, RULE), default)
    shared = spark.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [trie.match(h, p) if h or p else None for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and x[4] for x in found], pa.string()), pa.array([x[3] if x else default for x in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def filter_by_join(parts: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule lists of any size: each distinct (host, path) meets the rules of its host suffixes in equi joins.

    A host suffix with many rules is met by path prefix too, so no key gathers the rules of a whole domain: a first join tells at which path
    lengths a suffix's rules end, the second has the suffix and the path cut to each of these lengths as its key.
    """
    rank = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("block"), "verdict", F.concat("host", "path").alias("rule"))
    rules = rules.select(F.translate("host", CAPITALS, SMALL).alias("suffix"), F.col("path").alias("prefix"), rank.alias("rank"))
    rules = rules.groupBy("suffix", "prefix").agg(F.max("rank").alias("rank"))
    lengths = rules.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # at most as many as the longest path is long
    labels, most = F.split("host", "[.]"), rules.agg(F.max(F.size(F.split("suffix", "[.]")))).first()[0] or 1  # no suffix of more labels is needed
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    keys = parts.filter((F.col("host") != "") | (F.col("path") != "")).select("host", "path").distinct()
    cuts = skew_join(keys.select("host", "path", F.explode(suffixes).alias("suffix")).distinct(), lengths, ["suffix"], "inner")
    cuts = cuts.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    met = skew_join(cuts.select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("prefix")), rules, ["suffix", "prefix"], "inner")
    best = met.groupBy("host", "path").agg(F.max("rank").alias("rank"))
    out = skew_join(parts, best, ["host", "path"])
    return out.select("page_id", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT p.page_id, p.host, p.path, r.verdict, r.rhost || r.rpath AS rule,
             row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) + length(r.rpath) DESC) AS n
      FROM p LEFT JOIN r ON (p.host = r.rhost OR suffix(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
