"""Repeated-run metrics: cells, pass rates, stability, pass@k, intervals, latency.

A cell is one (model, problem, strategy); it holds n trials of which a were accepted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.functions import labels, stats
from steadyrun.functions.quantiles import percentiles, value_counts
from steadyrun.functions.spread import join_groups, positions

CELL = ["model_name", "problem_id", "strategy"]
TRIAL_KEY = [*CELL, "trial_index"]

# Trial indexes are numbered within spans of this length, so a long cell is many tasks.
SPAN = 32


def with_labels(trials: DataFrame) -> DataFrame:
    """Strategy normalised, verdict as 0/1 in ``accepted``."""
    prompt = F.col("prompt_type") if "prompt_type" in trials.columns else None
    return trials.withColumns(
        {
            "strategy": labels.normalize_strategy(F.col("strategy"), prompt),
            "accepted": labels.accepted(F.col("status")),
        }
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Written as ``row_number() <= 1`` so that Spark cuts each key to one row before the shuffle: a
    key that holds a third of all rows sends one row per map task. The hash leads the sort, so that
    most comparisons end at one long.
    """
    w = Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 1").drop("__rn")


def dedupe_trials(trials: DataFrame, order: Sequence[Column]) -> DataFrame:
    """An attempt read from several archives, or logged again on resume, counts once.

    Attempts without an index cannot be told apart, so one of them fails the job; number such a log
    with ``number_trials`` first.
    """
    missing = F.raise_error(F.lit("trial without an index: use number_trials first"))
    indexed = trials.withColumn("trial_index", F.coalesce(F.col("trial_index"), missing))
    return first_per_key(indexed, TRIAL_KEY, order)


def attempt_ordinals(trials: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """1-based arrival number of each attempt in its cell, as ``ordinal``."""
    return positions(trials, keys, order, "ordinal")


def number_trials(trials: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Trials with an index by arrival where they have none."""
    out = attempt_ordinals(trials, CELL, order)
    index = F.coalesce(F.col("trial_index"), (F.col("ordinal") - 1).cast("int"))
    return out.withColumn("trial_index", index).drop("ordinal")


def span_counts(trials: DataFrame) -> list[Column]:
    acc = F.col("accepted")
    out = [
        F.count(F.lit(1)).alias("n"),
        F.sum(acc).alias("a"),
        F.coalesce(F.max(F.when(F.col("trial_index") == 0, acc)), F.lit(0)).alias("first_pass"),
    ]
    if "latency_ms" in trials.columns:
        out.append(F.count_if(F.col("latency_ms") != 0).alias("latencies"))
    return out


def cell_counts(trials: DataFrame) -> DataFrame:
    """One row per cell: n, a, first_pass (0/1) and, where latencies are known, how many there are.

    A single map-side combined aggregate.
    """
    return trials.groupBy(*CELL).agg(*span_counts(trials))


def cells(trials: DataFrame) -> DataFrame:
    """``cell_counts`` with first_accepted, the 1-based ordinal of the first accepted trial (0: never).

    ``trials`` is deduplicated. Each span of ``SPAN`` indexes is one map-side combined aggregate that keeps
    the indexes seen and accepted as bits, so no attempt is sorted. Trials without an index come last, the
    accepted ones among them first.
    """
    index = F.col("trial_index")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(index, F.lit(SPAN)).cast("int"))
    spans = (
        trials.withColumn("span", F.coalesce(F.floor(index / SPAN), F.lit(1 << 40)))
        .groupBy(*CELL, "span")
        .agg(
            *span_counts(trials),
            F.bit_or(bit).alias("seen"),
            F.bit_or(F.when(F.col("accepted") == 1, bit)).alias("hits"),
        )
    )
    before_first = F.col("seen").bitwiseAND(F.expr("(hits & -hits) - 1"))
    hit = F.when(F.col("hits").isNotNull(), F.bit_count(before_first) + 1).when(
        F.col("seen").isNull() & (F.col("a") > 0), 1
    )
    return fold_spans(spans.withColumn("hit", hit).drop("seen", "hits"), F.col("n"))


def fold_spans(spans: DataFrame, size: Column) -> DataFrame:
    """Cells from their spans: ``span_counts`` and hit, the ordinal of the first accepted in the span."""
    earlier = Window.partitionBy(*CELL).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    return (
        spans.withColumn("hit", F.col("hit") + before)
        .groupBy(*CELL)
        .agg(
            F.sum("n").alias("n"),
            F.sum("a").alias("a"),
            F.max("first_pass").alias("first_pass"),
            F.coalesce(F.min("hit"), F.lit(0)).alias("first_accepted"),
            *[F.sum(c).alias(c) for c in ("latencies",) if c in spans.columns],
        )
    )


def cell_totals(
    cells: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 3, 5), timed: bool = False
) -> DataFrame:
    """Counts and rates per group; ``by`` may be empty for one overall row.

    With no ``ks``, the cheaper ``cell_counts`` is enough as input.
    """
    extra = [F.sum("latencies").alias("timed_runs")] if timed else []
    kept = ["timed_runs"] if timed else []
    return cells.groupBy(*by).agg(*total_exprs(ks), *extra).select(*by, *rate_exprs(ks), *kept)


def total_exprs(ks: Sequence[int] = (1, 3, 5)) -> list[Column]:
    n, a = F.col("n"), F.col("a")
    p = a / n
    return [
        F.count(F.lit(1)).alias("total_problems"),
        F.sum(n).alias("total_runs"),
        F.sum(a).alias("accepted_runs"),
        F.count_if(a == n).alias("stable_problems"),
        F.sum("first_pass").cast("bigint").alias("first_pass_problems"),
        F.avg(p * (1 - p)).alias("average_variance"),
        F.avg(unbiased_variance(n, a)).alias("average_variance_unbiased"),
        *[F.count_if(F.col("first_accepted").between(1, k)).alias(f"passed_at_{k}") for k in ks],
    ]


def unbiased_variance(n: Column, a: Column) -> Column:
    """n/(n-1) * p(1-p); 0 for a single trial."""
    p = a / n
    return F.coalesce(F.try_divide(n, n - 1) * p * (1 - p), F.lit(0.0))


def rate_exprs(ks: Sequence[int] = (1, 3, 5)) -> list[Column]:
    problems = F.col("total_problems")
    return [
        F.col("total_problems"),
        F.col("total_runs"),
        F.col("accepted_runs"),
        F.col("stable_problems"),
        F.col("first_pass_problems"),
        stats.rate(F.col("accepted_runs"), F.col("total_runs")).alias("run_level_pass_rate"),
        stats.rate(F.col("stable_problems"), problems).alias("perfect_stability_rate"),
        stats.rate(F.col("first_pass_problems"), problems).alias("first_pass_accuracy"),
        F.col("average_variance"),
        F.col("average_variance_unbiased"),
        *[stats.rate(F.col(f"passed_at_{k}"), problems).alias(f"pass_at_{k}") for k in ks],
    ]


def with_intervals(totals: DataFrame) -> DataFrame:
    """Wilson 95% intervals for the three rates."""
    out = totals
    for name, part, whole in (
        ("run_level", "accepted_runs", "total_runs"),
        ("first_pass", "first_pass_problems", "total_problems"),
        ("perfect_stability", "stable_problems", "total_problems"),
    ):
        out = out.withColumn(f"{name}_ci_95", stats.wilson(F.col(part), F.col(whole)))
    return out


LATENCY_PROBS = {"p50_latency_ms": 0.5, "p90_latency_ms": 0.9}


def latency_percentiles(
    trials: DataFrame, by: Sequence[str], approximate: bool = False
) -> DataFrame:
    """p50 and p90 of the latency; zero and null latencies are dropped."""
    kept = trials.where(F.col("latency_ms") != 0)
    if approximate:
        return kept.groupBy(*by).agg(
            *[F.percentile_approx("latency_ms", p, 10000).alias(c) for c, p in LATENCY_PROBS.items()]
        )
    return percentiles(value_counts(kept, by, "latency_ms"), by, LATENCY_PROBS)


def stability_summary(trials: DataFrame, by: Sequence[str], found: DataFrame | None = None) -> DataFrame:
    """The summary row per group: counts, rates, intervals, average variance, pass@k, latency.

    Cells count their latencies, and latencies are counted per verdict, so both halves read the same
    columns of ``trials`` and share its shuffle. ``found`` are the cells of ``trials``, if they are at hand.
    """
    found = cells(trials) if found is None else found
    totals = with_intervals(cell_totals(found, by, timed=True))
    counts = value_counts(trials.where(F.col("latency_ms") != 0), [*by, "accepted"], "latency_ms")
    latency = percentiles(counts, by, LATENCY_PROBS)
    return join_groups(totals, latency, by, "left").fillna(0.0, list(LATENCY_PROBS))


def grouped_stability(cells: DataFrame) -> DataFrame:
    """Metrics per (model, strategy) and per model in one pass of grouping sets.

    Cells keep their strategy, so the overall row of a model counts problem-strategy pairs.
    """
    m, s = F.col("model_name"), F.col("strategy")
    totals = cells.groupingSets([[m, s], [m]], m, s).agg(
        F.grouping(s).alias("overall"), *total_exprs()
    )
    label = F.when(F.col("overall") == 1, F.lit("overall")).otherwise(s)
    return totals.select(m, label.alias("strategy"), *rate_exprs())


def pass_at_k_rows(trials: DataFrame, keys: Sequence[str], by: Sequence[str], k: int) -> DataFrame:
    """pass@k from the first k rows of each key; Spark cuts to k rows per key before the shuffle."""
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy("trial_index")
    return (
        trials.withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= k)
        .groupBy(*keys)
        .agg(F.max("accepted").alias("hit"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("problems"), F.sum("hit").cast("bigint").alias("passed"))
        .withColumn("pass_at_k", stats.rate(F.col("passed"), F.col("problems")))
    )


def pass_at_k_arrays(rows: DataFrame, attempts: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """pass@k over rows that hold an array of attempt statuses."""
    hit = F.exists(F.slice(F.col(attempts), 1, k), lambda s: labels.accepted(s) == 1)
    return (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("problems"), F.count_if(hit).alias("passed"))
        .withColumn("pass_at_k", stats.rate(F.col("passed"), F.col("problems")))
    )
