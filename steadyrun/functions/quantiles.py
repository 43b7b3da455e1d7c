"""Exact percentiles whose state does not grow with the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.functions.spread import join_groups

BINS_PER_OCTAVE = 256
PARTS = 4096


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, v, f, bin): how often each number occurs, and its logarithmic bin. Combined map-side."""
    v = F.col("v")
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("v"))
        .where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    # The filter is the one a join on bin implies; stated here, all readers share one shuffle.
    bin_ = F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * BINS_PER_OCTAVE)
    return counted.withColumn("bin", bin_).where(F.col("bin").isNotNull())


def _spans(rows: DataFrame, keys: Sequence[str], bins: Sequence[str], wanted: Column) -> DataFrame:
    """The bins that hold a wanted rank: (keys, bins, __before, __total, __ranks, __lo, __hi).

    ``rows`` has v and f, and, below the first level, __before and __ranks of the bin above.
    """
    outer = [*keys, *bins[:-1]]
    above = [F.max("__before").alias("__base"), F.max("__ranks").alias("__asked")] if len(bins) > 1 else []
    total = [F.max("__total").alias("__all")] if len(bins) > 1 else []
    hist = rows.groupBy(*outer, bins[-1]).agg(
        F.sum("f").alias("f"), F.min("v").alias("__lo"), F.max("v").alias("__hi"), *above, *total
    )
    part = Window.partitionBy(*outer)
    upto = part.orderBy(bins[-1]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.col("__base") if above else F.lit(0)
    hist = hist.withColumns(
        {
            "__upto": base + F.sum("f").over(upto),
            "__before": base + F.sum("f").over(upto) - F.col("f"),
            "__total": F.col("__all") if total else F.sum("f").over(part),
        }
    )
    asked = F.col("__asked") if above else F.array_distinct(wanted)
    ranks = F.filter(asked, lambda r: (r >= F.col("__before")) & (r < F.col("__upto")))
    kept = hist.withColumn("__ranks", ranks).where(F.size("__ranks") > 0)
    return kept.select(*keys, *bins, "__before", "__total", "__ranks", "__lo", "__hi")


def percentiles(counts: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per ``keys`` from ``value_counts``.

    The built-in ``percentile`` keeps every distinct value of a group in one task. This form counts bins and
    finds the one or two that hold each wanted rank; these are cut into ``PARTS`` equal parts of the range of
    their values, and those that hold a rank once more, so that values crowded into a narrow range are spread
    as well. Only the values of the last parts are sorted.
    """
    keys, total = list(keys), F.col("__total")
    wanted = F.array(
        *[f((total - 1) * p).cast("bigint") for p in probs.values() for f in (F.floor, F.ceil)]
    )
    rows, bins = counts, ["bin"]
    for level in ("part", "piece"):
        spans = _spans(rows, keys, bins, wanted)
        rows = join_groups(rows.select(*keys, *bins, "v", "f"), spans, [*keys, *bins])
        place = F.try_divide((F.col("v") - F.col("__lo")) * PARTS, F.col("__hi") - F.col("__lo"))
        rows, bins = rows.withColumn(level, F.floor(F.coalesce(place, F.lit(0.0)))), [*bins, level]
    spans = _spans(rows, keys, bins, wanted)
    inside = (
        Window.partitionBy(*keys, *bins)
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = (
        join_groups(rows.select(*keys, *bins, "v", "f"), spans, [*keys, *bins])
        .withColumn("__last", F.col("__before") + F.sum("f").over(inside))
        .withColumn("__first", F.col("__last") - F.col("f"))
        .select(
            *keys,
            "__total",
            "v",
            F.explode(
                F.filter("__ranks", lambda r: (r >= F.col("__first")) & (r < F.col("__last")))
            ).alias("__rank"),
        )
    )
    # At most two ranks per probability reach this map.
    picked = hits.groupBy(*keys).agg(
        F.max("__total").alias("__total"),
        F.map_from_entries(F.collect_list(F.struct("__rank", "v"))).alias("__at"),
    )
    out = []
    for name, p in probs.items():
        pos = (total - 1) * p
        lo = F.try_element_at("__at", F.floor(pos).cast("bigint"))
        hi = F.try_element_at("__at", F.ceil(pos).cast("bigint"))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Percentiles of ``value`` per ``keys``, nulls dropped."""
    return percentiles(value_counts(df, keys, value), keys, probs)
