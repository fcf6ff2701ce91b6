"""URL filters by a sort-merge range join.

A rule has a host and a path prefix; it fits its host and all subdomains if
the path starts with the rule's. Hosts are written label by label from the
right, so a rule and the path it covers become one interval of canonical keys,
``com.example/de/`` up to the last key with that prefix, and the intervals of
rules are nested or disjoint. A URL is looked up once for each of its host's
ancestors that has rules: its key there is that ancestor and its path.

Rule starts, rule ends and URL keys are sorted together; the value carried
along the sort is the stack of rules open at that point, set by each start to
the rules around and including it and by each end to those around it. The
innermost rule on the stack is the longest that fits; of several ancestors'
winners the longest wins (host and path together, then the host alone).

Distinct (host, path) pairs are looked up, and the verdicts joined back. The
sweep is partitioned by ancestor; an ancestor with more than ``SPREAD`` keys (or
than it has rules, if those are more) is spread over several partitions, each
with a copy of that ancestor's rules.

A null URL or one without "://" has empty host and path, which no rule fits.
URLs without a fitting rule get the ``default`` verdict. Repeated rows are
judged alike. An empty table gives an empty result, an empty rule list the
default verdict for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderwell.llm.common import ascii_lower, or_empty, packed, table

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
SPREAD = 1_000
SALTS = 32


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(or_empty(url), r"^(?s:.*?)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(or_empty(url), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def ancestors(host: Column) -> Column:
    """Reversed keys of a host and of the domains above it."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _stacks(rules: DataFrame) -> DataFrame:
    """(anchor, path, stack, outer): each rule with the rules around it,
    outermost first, ending with itself; ``outer`` without it. Rules of one
    host enclose each other as their paths are prefixes of one another."""
    r = rules.select(reversed_host(ascii_lower(F.col("host"))).alias("anchor"), "path", F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"), F.col("verdict")).alias("rule"))
    # the same host and path twice: the last verdict by name holds
    r = r.groupBy("anchor", "path").agg(F.max("rule").alias("rule"))
    prefixes = r.select("anchor", F.col("path").alias("of"), F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))).alias("path"))
    around = prefixes.join(r, ["anchor", "path"]).groupBy("anchor", "of").agg(F.array_sort(F.collect_list("rule")).alias("stack"))
    return around.select("anchor", F.col("of").alias("path"), "stack",
                         F.slice("stack", 1, F.size("stack") - 1).alias("outer"))


def judge(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) -> (host, path, rule, verdict) for those that a
    rule fits."""
    stacks = _stacks(rules)
    # an ancestor may hold a third of all keys: joins on it are salted
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int").alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    probes = keys.select("host", "path", salt, F.explode(ancestors(F.col("host"))).alias("anchor")) \
        .join(stacks.select("anchor").distinct().select("anchor", every_salt), ["anchor", "salt"])
    # no more copies of an ancestor's rules than it has keys
    size = F.greatest(F.col("n_rules"), F.lit(SPREAD))
    spread = probes.groupBy("anchor").agg(F.count("*").alias("n")) \
        .join(stacks.groupBy("anchor").agg(F.count("*").alias("n_rules")), "anchor") \
        .select("anchor", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int")
    nothing = F.lit(None)
    # at one place, ends come before starts, and starts before URLs; an end
    # stands behind all keys with its prefix (no UTF-8 text has a byte FF)
    at_url = probes.join(spread.select("*", every_salt), ["anchor", "salt"]).select(
        "anchor", part.alias("part"), F.col("path").cast("binary").alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("inner"),
        nothing.cast(stacks.schema["stack"].dataType).alias("stack"), "host", "path")
    edges = stacks.join(spread, "anchor").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    event = lambda key, kind, inner, stack: edges.select(
        "anchor", "part", key.alias("key"), F.lit(kind).alias("kind"), inner.alias("inner"), stack.alias("stack"),
        nothing.cast("string").alias("host"), nothing.cast("string").alias("path"))
    depth = F.size("stack")
    start = F.col("path").cast("binary")
    events = at_url.unionByName(event(start, 1, depth, F.col("stack"))) \
        .unionByName(event(F.concat(start, F.lit(b"\xff")), 0, -depth, F.col("outer")))
    sweep = Window.partitionBy("anchor", "part").orderBy("key", "kind", "inner").rowsBetween(Window.unboundedPreceding, 0)
    open_ = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2 and size(open) > 0")
    best = open_.select("host", "path", F.element_at("open", -1).alias("best")).groupBy("host", "path").agg(F.max("best").alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def filtered(urls: DataFrame, url: str = "url", rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """(row, host, path, rule, verdict) for every row; ``row`` holds the
    input's columns."""
    rules = rule_table(urls.sparkSession) if rules is None else rules
    own = packed(urls, host_of(urls[f"`{url}`"]).alias("host"), path_of(urls[f"`{url}`"]).alias("path"))
    found = judge(own.select("host", "path").distinct(), rules)
    return own.join(found, ["host", "path"], "left").select(
        "row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filtered(pages).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
found AS (
  SELECT p.host, p.path, arg_max(r.host || r.path, length(r.host) + length(r.path) + length(r.host) / 1000.0) AS rule,
         arg_max(r.verdict, length(r.host) + length(r.path) + length(r.host) / 1000.0) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN found f ON p.host = f.host AND p.path = f.path
"""
