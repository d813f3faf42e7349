"""URL rules by a sorted sweep over reversed hosts.

A host is keyed by its labels from the last to the first, each followed by a dot, so a host
and all its subdomains are the keys from ``org.example.`` up to but without ``org.example/``:
a rule is an interval. Intervals of two hosts are nested or apart. Distinct hosts and rule
hosts are sorted together in range slices; a rule host opens its interval and carries the
stack of rules that are open there, a host takes the stack opened last and keeps the entries
whose interval still holds its key. What is open at the start of a slice comes from the
slices before it. The paths of the stack's rules are then tested per page.

A null url, or one without ``://``, has empty host and path and fits no rule, nor does an
empty host. Of rules that fit, the longest wins, then the one with the longer host, then block
over allow; equal rules count once. Rules with a null host are left out, a null path is empty.
Other columns of the pages are kept inside ``page``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspan.llm import shared
from dayspan.session import shuffle_width


def url_host(url: Column) -> Column:
    return shared.ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """``blog.example.org`` as ``org.example.blog.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule host the rules of all rule hosts that it lies in, itself included."""
    clean = rules.filter(F.col("host").isNotNull() & (F.col("host") != "")).select(
        shared.ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    entry = F.struct(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    own = clean.groupBy(host_key(F.col("host")).alias("key")).agg(F.collect_list(entry).alias("rules"))
    labels = F.split("key", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    above = own.select("key", F.explode(prefixes).alias("outer"))
    outer = own.select(F.col("key").alias("outer"), F.col("rules"))
    return above.join(outer, "outer").groupBy("key").agg(F.flatten(F.collect_list("rules")).alias("stack"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack): the open rules of each distinct host that has any."""
    stacks = rule_stacks(rules)
    events = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host").unionByName(
        stacks.select("key", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True)
    width = shuffle_width(hosts)
    sliced = shared.stored(events.repartitionByRange(width, "key").withColumn("slice", F.spark_partition_id()), "url-sweep")
    opened = F.last(F.when(F.col("kind") == 0, F.col("stack")), ignorenulls=True)
    last = sliced.filter("kind = 0").groupBy("slice").agg(F.max_by("stack", "key").alias("left_open"))
    every = sliced.select("slice").distinct().join(last, "slice", "left")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    carried = every.select("slice", F.last("left_open", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = sliced.join(carried, "slice", "left").withColumn("open", F.coalesce(opened.over(sweep), F.col("carried"))).filter("kind = 1")
    fitting = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]))
    return swept.select("host", fitting.alias("stack")).filter(F.size("stack") > 0)


def judge(pages: DataFrame, url: str, rules: DataFrame, otherwise: str) -> DataFrame:
    """(page, host, path, rule, verdict); ``page`` holds all columns of the input."""
    rows = pages.select(F.struct("*").alias("page"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    hosts = rows.filter("host <> ''").groupBy("host").agg(F.lit(1).alias("one"))
    found = host_rules(hosts, rules)
    rows = rows.join(found, "host", "left")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("a"), F.length(r["key"]).alias("b"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return rows.select("page", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(otherwise)).alias("verdict"))
