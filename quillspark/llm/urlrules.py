"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule (host, path) holds on its host and all subdomains for paths that start with
its path.  Its key is the host's labels in reverse, a separator, and the path; the
strings that start with a key are the interval from the key to the key and byte FF.
Such intervals nest or are disjoint.  A url asks with one key for each suffix of its
host.  Rules' ends and urls' keys are sorted together; a sweep carries the stack of
rules that are active at each place, and the last of them is the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x01"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), upper, upper.lower())
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(SEPARATOR), path)


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Sweep events (area, at, stack) of rules (host, path, verdict).

    `stack` holds the rules active from `at` on, outermost first.  Null hosts and paths
    count as empty; of equal rules the one that blocks counts.
    """
    named = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = named.select(
        _key(_labels(F.col("host")), F.col("path")).alias("key"),
        F.element_at(_labels(F.col("host")), 1).alias("area"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict").alias("own"),
    )
    outer = keyed.select(F.col("key").alias("outer_key"), F.struct(F.length("key").alias("n"), F.col("own")).alias("outer"))
    prefixes = keyed.select("key", "area", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("outer_key"))
    nested = prefixes.join(outer, "outer_key").groupBy("area", "key").agg(F.transform(F.array_sort(F.collect_list("outer")), lambda x: x["own"]).alias("stack"))
    at = F.col("key").cast("binary")
    starts = nested.select("area", at.alias("at"), "stack")
    ends = nested.select("area", F.concat(at, F.expr("X'FF'")).alias("at"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("stack"))
    return starts.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """`pages` with host, path, rule and verdict added; columns of these names are replaced.

    The longest rule that fits wins (host and path together, then host); without one,
    rule is null and the verdict is `default`.  Each distinct url is judged once.  A busy
    top-level domain is dealt over `salts` sweeps (twice the shuffle partitions unless
    given), each with its own copy of that domain's rules.
    """
    salts = salts or 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path})
    labels = _labels(F.col("host"))
    asked = pages.select("host", "path").distinct().select(
        F.element_at(labels, 1).alias("area"),
        F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")).cast("binary"))).alias("at"),
        "host",
        "path",
    )
    events = rule_stacks(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    line = asked.withColumn("url", F.lit(1)).unionByName(events.withColumn("url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("area", "salt").orderBy("at", "url").rowsBetween(Window.unboundedPreceding, 0)
    swept = line.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where((F.col("url") == 1) & (F.size("active") > 0))
    best = swept.groupBy("host", "path").agg(F.max(F.element_at("active", -1)).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    found = pages.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
