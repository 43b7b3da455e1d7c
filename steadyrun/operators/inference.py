"""Resampling, tests and regression. All start from aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.functions import stats
from steadyrun.functions.spread import join_groups, positions
from steadyrun.sources.scratch import stored

#: Up to this mean a binomial draw walks the distribution, which then ends well within ``STEPS``.
WALKED_MEAN = 32
STEPS = 128


def uniform(text: Column, part: int) -> Column:
    """A number between 0 and 1 from 48 bits of an md5; there are two ``part``s."""
    digits = F.substring(F.md5(text), 1 + 12 * part, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def binomial(n: Column, part: Column, whole: Column, key: Column) -> Column:
    """How many of ``n`` draws fall to ``part`` of ``whole``, drawn with the md5 of ``key``.

    The inverse of the distribution at one uniform number, walked value by value up to a mean of ``WALKED_MEAN``
    (of the rarer side), and a rounded normal draw beyond it.
    """
    rare = F.least(part, whole - part)
    p = rare.cast("double") / whole
    mean = n * p
    u = uniform(key, 0)
    # What is left beyond this place is less than the uniform numbers can tell apart.
    steps = F.least(n, F.lit(STEPS - 1), F.ceil(mean + 8 * F.sqrt(mean) + 10)).cast("int")
    start = F.struct(F.exp(n * F.log(1 - p)).alias("at"), F.lit(0.0).alias("below"), F.lit(0.0).alias("k"))
    walked = F.aggregate(
        F.sequence(F.lit(0), steps),
        start,
        lambda s, i: F.struct(
            (s["at"] * (n - i) / (i + 1) * (p / (1 - p))).alias("at"),
            (s["below"] + s["at"]).alias("below"),
            (s["k"] + F.when(s["below"] + s["at"] < u, 1.0).otherwise(0.0)).alias("k"),
        ),
        lambda s: s["k"],
    )
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(key, 1))
    far = F.floor(mean + F.sqrt(mean * (1 - p)) * normal + 0.5).cast("double")
    drawn = F.when(mean <= WALKED_MEAN, walked).otherwise(F.greatest(far, F.lit(0.0)))
    drawn = F.least(drawn.cast("bigint"), n)
    return F.when(2 * part > whole, n - drawn).otherwise(drawn)


def bootstrap_mean(
    values: DataFrame, by: Sequence[str], value: str, replicates: int = 1000, seed: int = 0
) -> DataFrame:
    """95% percentile bootstrap of the mean of ``value`` per group, in native expressions.

    Drawing a group's rows with replacement is a multinomial draw over its distinct values. These are numbered in
    order, which makes them the leaves of a binary tree; a replicate's draws are split on the way down, each
    node's by one binomial draw from the md5 of seed, group, replicate, level and node. So results repeat, on any
    engine, and no group meets in one task: a row is a node that a replicate reached.
    """
    by = list(by)
    counted = values.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    numbered = positions(counted.where("__v is not null"), by, [F.col("__v")], "__at")
    leaves = stored(numbered.withColumn("__at", F.col("__at") - 1), "values")
    depth = int(leaves.agg(F.coalesce(F.max("__at"), F.lit(0))).first()[0]).bit_length()
    rows = leaves.groupBy(*by).agg(F.sum("__n").alias("__drawn"))
    rows = rows.withColumn("__rows", F.col("__drawn")).withColumn("__node", F.lit(0).cast("bigint"))
    rows = rows.withColumn("__replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # A few groups become many rows here; by a number of parts, as Spark would put so few bytes into one task.
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *by, "__replicate")
    label = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    for level in range(depth):
        below = depth - 1 - level
        own = leaves.withColumn("__node", F.shiftright("__at", below + 1))
        left = F.sum(F.when(F.expr(f"(shiftright(__at, {below}) & 1) = 0"), F.col("__n")).otherwise(0))
        split = own.groupBy(*by, "__node").agg(left.alias("__left"), F.sum("__n").alias("__whole"))
        key = F.concat_ws("|", F.lit(str(seed)), *label, F.col("__replicate").cast("string"), F.lit(str(level)), F.col("__node").cast("string"))
        met = join_groups(rows, split, [*by, "__node"])
        met = met.withColumn("__first", binomial(F.col("__drawn"), F.col("__left"), F.col("__whole"), key))
        sides = F.array(
            F.struct((F.col("__node") * 2).alias("node"), F.col("__first").alias("drawn")),
            F.struct((F.col("__node") * 2 + 1).alias("node"), (F.col("__drawn") - F.col("__first")).alias("drawn")),
        )
        side = F.explode(F.filter(sides, lambda x: x["drawn"] > 0)).alias("side")
        met = met.select(*by, "__replicate", "__rows", side)
        rows = met.select(*by, "__replicate", "__rows", F.col("side.node").alias("__node"), F.col("side.drawn").alias("__drawn"))
    drawn = join_groups(rows, leaves.select(*by, F.col("__at").alias("__node"), "__v"), [*by, "__node"])
    totals = drawn.groupBy(*by, "__replicate", "__rows").agg(F.sum(F.col("__drawn") * F.col("__v")).alias("__sum"))
    means = totals.select(*by, (F.col("__sum") / F.col("__rows")).alias("mean"))
    # At most ``replicates`` values per group.
    return means.groupBy(*by).agg(
        F.percentile("mean", F.lit(0.025)).alias("lo"),
        F.percentile("mean", F.lit(0.975)).alias("hi"),
        F.count(F.lit(1)).alias("replicates"),
    )


def variance_interval(cells: DataFrame, by: Sequence[str], **settings) -> DataFrame:
    """Bootstrap interval of the average variance p (1 - p) of the cells of each group."""
    p = F.col("a") / F.col("n")
    drawn = bootstrap_mean(cells.withColumn("__variance", p * (1 - p)), by, "__variance", **settings)
    return drawn.select(*by, F.struct("lo", "hi").alias("average_variance_ci_95"))


def with_variance_interval(summary: DataFrame, cells: DataFrame, by: Sequence[str], **settings) -> DataFrame:
    """``summary`` with average_variance_ci_95, the interval that only resampling gives."""
    return join_groups(summary, variance_interval(cells, by, **settings), by, "left")


def pooled_t_test(df: DataFrame, by: Sequence[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """Two-sample t with pooled variance between groups ``a`` and ``b``; null values dropped."""
    out = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(*by).agg(
        *[
            f(F.when(F.col(group) == g, F.col(value))).alias(f"{name}_{side}")
            for side, g in (("a", a), ("b", b))
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    dof = n_a + n_b - 2
    pooled = F.try_divide((n_a - 1) * F.col("var_a") + (n_b - 1) * F.col("var_b"), dof)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    return (
        out.select(
            *by,
            n_a,
            n_b,
            (F.col("mean_a") - F.col("mean_b")).alias("mean_difference"),
            F.try_divide(F.col("mean_a") - F.col("mean_b"), error).alias("t"),
            dof.cast("bigint").alias("dof"),
        )
        .withColumn("p", stats.t_pvalue(F.col("t"), F.col("dof").cast("double")))
        .withColumn("significant", F.col("p") < 0.05)
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares y ~ x as one row: slope, intercept, r, r2, std_err, p, n."""
    fit = df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("r"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("__sxx"),
        F.regr_syy(y, x).alias("__syy"),
    )
    dof = F.col("n") - 2
    left = F.greatest(F.lit(0.0), F.col("__syy") * (1 - F.col("r2")))
    fit = fit.withColumn("std_err", F.sqrt(F.try_divide(left, dof * F.col("__sxx"))))
    return fit.withColumn(
        "p", stats.t_pvalue(F.try_divide(F.col("slope"), F.col("std_err")), dof.cast("double"))
    ).drop("__sxx", "__syy")


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    """``residual`` of y ~ x on every row; the fit is a scalar subquery, run once."""
    fit = df.agg(
        F.struct(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
        ).alias("fit")
    ).scalar()
    return (
        df.withColumn("__fit", fit)
        .withColumn(
            "residual",
            F.col(y) - (F.col("__fit.intercept") + F.col("__fit.slope") * F.col(x)),
        )
        .drop("__fit")
    )


def permutation_test(
    df: DataFrame, ident: Sequence[str], flag: str, value: str, permutations: int = 10000
) -> DataFrame:
    """Two-sided permutation test of the difference of means between flagged and other rows.

    Permutation r orders the rows by md5(r | id) and labels the first ones as flagged. Values are
    held as integer billionths, so sums do not depend on the order of addition. The input has one
    row per configuration; each permutation is its own group of that many rows.
    """
    rows = df.select(
        F.concat_ws("|", *ident).alias("id"),
        F.col(flag).alias("flag"),
        F.round(F.col(value) * 1e9).cast("bigint").alias("v"),
    )
    size = rows.agg(
        F.struct(
            F.count_if("flag").alias("k"),
            F.count(F.lit(1)).alias("n"),
            F.sum("v").alias("total"),
            F.coalesce(F.sum(F.when(F.col("flag"), F.col("v"))), F.lit(0)).alias("flagged"),
        ).alias("size")
    ).scalar()

    def gap(flagged: Column) -> Column:
        # |mean difference| * k * (n - k), in integers
        k, n, total = F.col("size.k"), F.col("size.n"), F.col("size.total")
        return F.abs(flagged * (n - k) - (total - flagged) * k)

    order = Window.partitionBy("rep").orderBy(
        F.md5(F.concat_ws("|", F.col("rep").cast("string"), F.col("id"))), "id"
    )
    spread = (
        rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        .withColumn("rn", F.row_number().over(order))
        .withColumn("size", size)
        .groupBy("rep")
        .agg(
            F.first("size").alias("size"),
            F.coalesce(F.sum(F.when(F.col("rn") <= F.col("size.k"), F.col("v"))), F.lit(0)).alias("f"),
        )
    )
    k, n, total = F.col("size.k"), F.col("size.n"), F.col("size.total")
    return (
        spread.groupBy("size")
        .agg(
            F.count(F.lit(1)).alias("permutations"),
            F.count_if(gap(F.col("f")) >= gap(F.col("size.flagged"))).alias("extreme"),
        )
        .select(
            "permutations",
            "extreme",
            (F.col("extreme") / F.col("permutations")).alias("p"),
            (
                F.try_divide(F.col("size.flagged"), k) / 1e9
                - F.try_divide(total - F.col("size.flagged"), n - k) / 1e9
            ).alias("observed"),
        )
    )


def mcnemar(cells: DataFrame, by: Sequence[str], a: str = "detailed", b: str = "minimal") -> DataFrame:
    """Exact McNemar test on paired perfect-stability marks of two prompts.

    A pair is one problem judged under both prompts. ``b_only`` and ``c_only`` count problems stable
    under just one of them.
    """
    stable = (F.col("a") == F.col("n")).cast("int")
    pairs = (
        cells.where(F.col("strategy").isin(a, b))
        .groupBy(*by, "problem_id")
        .agg(
            F.max(F.when(F.col("strategy") == a, stable)).alias("x"),
            F.max(F.when(F.col("strategy") == b, stable)).alias("y"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    return (
        pairs.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("pairs"),
            F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b_only"),
            F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c_only"),
        )
        .withColumn("p", stats.mcnemar_pvalue(F.col("b_only"), F.col("c_only")))
    )
