"""Running totals, positions and ranks that never put one whole group into one task.

A plain window puts a whole partition key into one task. Here the rows are cut into ranges of the full order, key
first, whose bounds Spark samples from the rows; each range is summed on its own, and a key that goes on from
earlier ranges starts from what they add up to (a prefix sum in two levels). Rows that are equal in key and order
are dealt by a hash of all their columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.sources.scratch import stored


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables of the same groups; a null key is a group like any other.

    A plain equality would also push "key is not null" into one branch only, and branches that read the
    same table could no longer share its shuffle.
    """
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None = None
) -> DataFrame:
    """``df`` with __range, the number of the row's range in the order (keys, order, hash of the row), and __tie,
    that hash. Written once, so that all readers see the same ranges.

    ``ranges`` is the number of shuffle partitions unless given. Only rows that are equal in all columns can't
    be told apart and stay in one range.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("__tie", F.xxhash64(*df.columns))
    cut = tied.repartitionByRange(ranges, *[F.col(k) for k in keys], *order, F.col("__tie"))
    return stored(cut.withColumn("__range", F.spark_partition_id()), "ranges")


def _carried(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(__range, __key, __c_...): what earlier ranges add up to for the first key of each range.

    Ranges are sorted by key, so no other key of a range has rows before it. One row per range.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    sums = rows.groupBy("__range", *keys).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    ends = sums.groupBy("__range").agg(
        F.min(key).alias("__key"), F.max(key).alias("__last"), *[F.max_by(f"__s_{n}", key).alias(f"__s_{n}") for n in names]
    )
    upto = Window.partitionBy("__last").orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ends.withColumns({f"__s_{n}": F.sum(f"__s_{n}").over(upto) for n in names})
    before = Window.orderBy("__range")
    goes_on = F.lag("__last").over(before).eqNullSafe(F.col("__key"))
    return totals.select(
        "__range", "__key", *[F.when(goes_on, F.lag(f"__s_{n}").over(before)).otherwise(F.lit(0)).alias(f"__c_{n}") for n in names]
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], ranges: int | None = None
) -> DataFrame:
    """Inclusive running sums of ``values`` per ``keys`` in ``order``; null keys are keys like others.

    Rows that ``order`` does not tell apart go by a hash of their columns. Order columns are compared as Spark
    sorts them, so ``F.desc`` and the like can be used.
    """
    keys, names = list(keys), list(values)
    rows = in_ranges(df.withColumns({f"__v_{n}": c for n, c in values.items()}), keys, order, ranges)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    local = (
        Window.partitionBy("__range", *keys)
        .orderBy(*order, "__tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    told = rows.join(_carried(rows, keys, names), "__range")
    start = {n: F.when(key.eqNullSafe(F.col("__key")), F.col(f"__c_{n}")).otherwise(F.lit(0)) for n in names}
    out = told.withColumns({n: start[n] + F.sum(f"__v_{n}").over(local) for n in names})
    return out.drop("__range", "__tie", "__key", *[f"__{k}_{n}" for k in "vc" for n in names])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, ranges: int | None = None
) -> DataFrame:
    """1-based row number per ``keys`` in ``order``."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, ranges)


def ranks(df: DataFrame, keys: Sequence[str], by: str, names: tuple[str, str], ranges: int | None = None) -> DataFrame:
    """Rank and dense rank per ``keys`` by descending ``by``, nulls last, under the two ``names``.

    Rows are counted per distinct value first, and only the values are put in order.
    """
    held = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("__n"))
    rank, dense = names
    told = running_totals(held, keys, [F.desc_nulls_last(by)], {rank: F.col("__n"), dense: F.lit(1).cast("bigint")}, ranges)
    told = told.select(*keys, by, (F.col(rank) - F.col("__n") + 1).alias(rank), dense)
    return join_groups(df, told, [*keys, by])
