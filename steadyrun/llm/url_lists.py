"""Operator 9: URL lists as of the day a page was fetched.

A list is a log of dated entries: a pattern is added or removed, with the verdict block or allow. Entries
become validity intervals (one state per list, pattern, verdict and day, so their number is bounded by days,
not by rows), and every capture is joined as of its fetch day to the patterns that match it: its host, the
domains above it, and the path prefixes of its host. The most specific pattern in force decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, verdict, list_name, valid_from, valid_until) from entries (list_name, pattern, verdict, action,
    effective); valid_until is the first day out of force, null while it is in force.

    Entries of the same day: an add beats a remove. A remove of what isn't listed, and an add of what is, change
    nothing. Entries that lack a pattern, verdict, action or day are ignored; a null list is a list like others.
    """
    keys = ["list_name", "pattern", "verdict"]
    used = entries.select(
        "list_name", F.lower("pattern").alias("pattern"), "verdict", "action", F.col("effective").cast("date").alias("day")
    ).where("pattern is not null and verdict is not null and action in ('add', 'remove') and day is not null")
    days = used.groupBy(*keys, "day").agg(F.max((F.col("action") == "add").cast("int")).alias("listed"))
    order = Window.partitionBy(*keys).orderBy("day")
    turns = days.withColumn("before", F.coalesce(F.lag("listed").over(order), F.lit(0))).where("listed <> before")
    ends = turns.withColumn("valid_until", F.lead("day").over(order)).where("listed = 1")
    return ends.select(*keys, F.col("day").alias("valid_from"), "valid_until")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns(url: Column, labels: int, depth: int) -> Column:
    """What can list a URL, as far as listed patterns go: its host and the domains above it, of at most ``labels``
    labels, and the host with the leading parts of the path, at most ``depth`` of them."""
    names, parts = F.split(_host(url), r"\."), F.filter(F.split(_path(url), "/"), lambda p: p != "")
    nothing = F.array().cast("array<string>")
    own = F.slice(names, F.greatest(F.size(names) - labels + 1, F.lit(1)), F.lit(labels))
    domains = F.transform(
        F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.array_join(F.slice(own, k + 1, F.size(own)), ".")
    )
    led = F.slice(parts, F.lit(1), F.lit(depth)) if depth else nothing
    folders = F.transform(
        F.when(F.size(led) > 0, F.sequence(F.lit(1), F.size(led))).otherwise(F.array().cast("array<int>")),
        lambda k: F.concat(_host(url), F.lit("/"), F.array_join(F.slice(led, F.lit(1), k), "/")),
    )
    every = F.array_distinct(F.concat(domains, F.transform(folders, F.lower)))
    return F.when(_host(url) != "", every).otherwise(nothing)


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched and other columns) with columns verdict, pattern and kept.

    Of the patterns in force on the day of the fetch the longest decides; where both verdicts hold for it,
    block does. verdict and pattern are null where none is in force, or the url or day is null or no URL;
    kept is false for block only. Rows that repeat each get their verdict. Columns of those names are replaced.
    Of a very long host or path only what is as long as the longest listed one is looked up.
    """
    held = intervals(entries).select("pattern", "verdict", "valid_from", "valid_until").distinct()
    steps = F.split("pattern", "/")
    labels, depth = held.agg(F.max(F.size(F.split(steps[0], r"\."))), F.max(F.size(steps) - 1)).first()
    own = captures.select(F.col("url").alias("__url"), F.col("fetched").cast("date").alias("__day"))
    asked = own.where("__url is not null and __day is not null").distinct()
    each = asked.select("__url", "__day", F.explode(patterns(F.col("__url"), labels or 1, depth or 0)).alias("pattern"))
    in_force = (F.col("__day") >= F.col("valid_from")) & (
        F.col("valid_until").isNull() | (F.col("__day") < F.col("valid_until"))
    )
    met = each.join(held, "pattern").where(in_force)
    rank = F.struct(F.length("pattern"), F.col("verdict") == "block", F.col("pattern"), F.col("verdict"))
    verdicts = met.groupBy("__url", "__day").agg(F.max(rank).alias("__best"))
    kept = [c for c in captures.columns if c not in ("verdict", "pattern", "kept")]
    on = (F.col("url") == F.col("__url")) & (F.col("fetched").cast("date") == F.col("__day"))
    verdict = F.col("__best.verdict")
    return captures.join(verdicts, on, "left").select(
        *kept, verdict.alias("verdict"), F.col("__best.pattern").alias("pattern"),
        F.coalesce(verdict != "block", F.lit(True)).alias("kept"),
    )
