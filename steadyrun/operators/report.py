"""Breakdowns of judged attempts.

Inputs are trials with clean ``strategy`` and 0/1 ``accepted``. Wherever a problem attribute is
needed, attempts are first summed per problem and prompt (map-side), so a problem with very many
attempts is one short row before it meets the problem table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from steadyrun.functions import labels, stats
from steadyrun.functions.quantiles import percentiles, value_counts
from steadyrun.functions.spread import join_groups
from steadyrun.operators import problems as prob
from steadyrun.operators import stability

# Prompts and tiers that every report shows, present in the data or not.
PROMPTS = ["detailed", "minimal"]
REPORT_TIERS = ["Easy", "Medium", "Hard"]


def counts():
    return [F.count(F.lit(1)).alias("total"), F.sum("accepted").alias("accepted")]


def pass_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("pass_rate", stats.rate(F.col("accepted"), F.col("total")))


def per_problem(trials: DataFrame, *keys: str) -> DataFrame:
    return trials.groupBy(*keys, "problem_id", "strategy").agg(*counts())


def pass_rate_by_prompt(trials: DataFrame, *keys: str) -> DataFrame:
    return pass_rate(trials.groupBy(*keys, "strategy").agg(*counts()))


def pass_rate_by_difficulty(trials: DataFrame, problems: DataFrame) -> DataFrame:
    """One row per fixed tier: totals and rates of both prompts, and their difference."""
    sums = prob.with_difficulty(per_problem(trials), problems)

    def side(prompt: str, col: str):
        return F.coalesce(F.sum(F.when(F.col("strategy") == prompt, F.col(col))), F.lit(0))

    found = sums.groupBy("difficulty").agg(
        *[side(p, c).alias(f"{p}_{c}") for p in PROMPTS for c in ("total", "accepted")]
    )
    tiers = trials.sparkSession.createDataFrame([(t,) for t in REPORT_TIERS], "difficulty string")
    out = tiers.join(found, "difficulty", "left").fillna(0)
    for p in PROMPTS:
        out = out.withColumn(f"{p}_pass_rate", stats.rate(F.col(f"{p}_accepted"), F.col(f"{p}_total")))
    return out.withColumn("difference", F.col("detailed_pass_rate") - F.col("minimal_pass_rate"))


def status_key(prompt, status):
    return F.concat(prompt, F.lit("_"), F.replace(F.lower(status), F.lit(" "), F.lit("_")), F.lit("_count"))


def failure_counts(trials: DataFrame) -> DataFrame:
    return (
        trials.where(F.col("accepted") == 0)
        .groupBy("strategy", "status")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("key", status_key(F.col("strategy"), F.col("status")))
    )


def status_pivot(trials: DataFrame, prompts: Sequence[str] = PROMPTS) -> DataFrame:
    """One row per status, one count column per prompt, 0 where none."""
    return trials.groupBy("status").pivot("strategy", list(prompts)).count().na.fill(0)


def failure_share(trials: DataFrame) -> DataFrame:
    """Share of each verdict among attempts that were not accepted."""
    found = trials.where(F.col("accepted") == 0).groupBy("status").agg(F.count(F.lit(1)).alias("count"))
    return found.withColumn("share", stats.rate(F.col("count"), found.agg(F.sum("count")).scalar()))


def generation_latency(trials: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean, median and p90; null dropped, zero kept."""
    found = value_counts(trials, by, "latency_ms")
    mean = found.groupBy(*by).agg((F.sum(F.col("v") * F.col("f")) / F.sum("f")).alias("mean_latency_ms"))
    probs = {"median_latency_ms": 0.5, "p90_latency_ms": 0.9}
    return join_groups(mean, percentiles(found, by, probs), by)


def generation_tokens(trials: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean input, output and total tokens and cost; a total of 0 is dropped."""
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return trials.groupBy(*by).agg(
        F.avg("input_tokens").alias("mean_input_tokens"),
        F.avg("output_tokens").alias("mean_output_tokens"),
        F.avg(F.nullif(total, F.lit(0))).alias("mean_total_tokens"),
        F.avg("cost").alias("mean_cost"),
    )


def judge_performance(trials: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean, median and deviation of accepted attempts' runtime and memory percentiles."""
    by, metrics = list(by), ("runtime", "memory")
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_percentile").alias("value")) for m in metrics]
    )
    rows = trials.where(F.col("accepted") == 1).select(*by, F.inline(pairs))
    keys = [*by, "metric"]
    found = value_counts(rows, keys, "value")
    value = F.col("value")
    moments = rows.where(value.isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        (F.count_if(value >= 75) * 100.0 / F.count(F.lit(1))).alias("top"),
    )
    both = join_groups(moments, percentiles(found, keys, {"median": 0.5}), keys)

    def pick(metric: str, col: str, name: str):
        return F.max(F.when(F.col("metric") == metric, F.col(col))).alias(name)

    stat = [pick(m, c, f"{c}_{m}_percentile") for m in metrics for c in ("mean", "median", "std")]
    return both.groupBy(*by).agg(*stat, pick("runtime", "top", "top_25_runtime_pct"))


def prompt_effect(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pass@1 of both prompts, difference, relative improvement, mean runtime percentile difference.

    The improvement is infinite where only the minimal rate is 0, and 0 where both are.
    """
    keys = list(keys)
    rates = stability.pass_at_k_rows(trials, [*keys, "problem_id", "strategy"], [*keys, "strategy"], 1)

    def side(prompt: str, col: str):
        return F.max(F.when(F.col("strategy") == prompt, F.col(col)))

    rates = rates.groupBy(*keys).agg(
        *[F.coalesce(side(p, "pass_at_k"), F.lit(0.0)).alias(f"{p}_pass_at_1") for p in PROMPTS]
    )
    good = trials.where(F.col("accepted") == 1).groupBy(*keys).agg(
        *[
            F.avg(F.when(F.col("strategy") == p, F.col("runtime_percentile"))).alias(f"__{p}")
            for p in PROMPTS
        ]
    )
    d, m = F.col("detailed_pass_at_1"), F.col("minimal_pass_at_1")
    better = (
        F.when(m > 0, F.try_divide(d - m, m) * 100)
        .when(d > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )
    joined = rates.join(good, keys, "left") if keys else rates.withColumn("__k", F.lit(1)).join(
        good.withColumn("__k", F.lit(1)), "__k", "left"
    )
    return joined.select(
        *keys,
        d,
        m,
        (d - m).alias("pass_rate_difference"),
        better.alias("pass_rate_improvement"),
        (F.col("__detailed") - F.col("__minimal")).alias("runtime_percentile_difference"),
    )


def with_topics(sums: DataFrame, problems: DataFrame) -> DataFrame:
    dim = problems.select(F.col("frontend_question_id").alias("problem_id"), "topics")
    return sums.join(dim, "problem_id").where(F.col("topics").isNotNull())


def summed(df: DataFrame, *keys: str) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("accepted").alias("accepted"))
    return pass_rate(out)


def topic_rates(trials: DataFrame, problems: DataFrame) -> DataFrame:
    """Success rate per topic and prompt."""
    rows = with_topics(per_problem(trials), problems)
    topics = rows.withColumn("topic", F.explode(labels.split_topics(F.col("topics"))))
    return summed(topics, "topic", "strategy")


def topic_heatmap(trials: DataFrame, problems: DataFrame, top: int = 10) -> DataFrame:
    """Rates per prompt of the most frequent topics, counted wherever the topics text contains one.

    Attempts are summed per topics text first; the top list carries its sums along, so that both
    readers of those sums share one shuffle. It holds ``top`` entries and travels as one array.
    """
    rows = with_topics(per_problem(trials), problems)
    texts = rows.groupBy("topics", "strategy").agg(
        F.sum("total").alias("total"), F.sum("accepted").alias("accepted")
    )
    best = (
        texts.select(F.explode(labels.split_topics(F.col("topics"))).alias("topic"), "total", "accepted")
        .groupBy("topic")
        .agg(F.sum("total").alias("attempts"), F.sum("accepted").alias("accepted"))
        .orderBy(F.desc("attempts"), "topic")
        .limit(top)
        .agg(F.collect_list(F.struct("topic", "attempts", "accepted")))
        .scalar()
    )
    hits = texts.withColumn("__best", best).withColumn(
        "topic",
        F.explode(
            F.transform(
                F.filter("__best", lambda b: F.contains(F.col("topics"), b.topic)), lambda b: b.topic
            )
        ),
    )
    return summed(hits, "topic", "strategy")


def percentile_histogram(trials: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between each prompt's own extremes, last bin closed, empty bins kept."""
    good = trials.where((F.col("accepted") == 1) & F.col(value).isNotNull())
    # Equal values are counted before anything else, so the bounds join sees few rows.
    freq = good.groupBy("strategy", F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    bounds = freq.groupBy("strategy").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select(
        "strategy",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    counted = (
        freq.join(bounds, "strategy")
        .withColumn(
            "bin", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
        )
        .groupBy("strategy", "bin")
        .agg(F.sum("c").alias("count"))
    )
    grid = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["strategy", "bin"], "left").select(
        "strategy",
        F.lit(value).alias("metric"),
        "bin",
        (F.col("lo") + F.col("width") * F.col("bin")).alias("edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def runtime_memory_pairs(trials: DataFrame) -> DataFrame:
    good = trials.where(F.col("accepted") == 1)
    return good.select(
        "strategy", "model_name", "problem_id", "trial_index", "runtime_percentile", "memory_percentile"
    ).dropna(subset=["runtime_percentile", "memory_percentile"])


def trial_matrix(trials: DataFrame, problems: DataFrame) -> DataFrame:
    """The problem x trial grid of the detailed prompt, one row per attempt that exists.

    ``width`` is the model's longest row; an index below it with no row stands for 0.
    """
    rows = trials.where(F.col("strategy") == "detailed")
    width = rows.groupBy("model_name").agg((F.max("trial_index") + 1).alias("width"))
    title = F.col("title")
    short = F.when(F.length(title) > 30, F.concat(F.substring(title, 1, 30), F.lit("..."))).otherwise(title)
    dim = problems.select(F.col("frontend_question_id").alias("problem_id"), short.alias("title"))
    return rows.join(dim, "problem_id", "left").join(width, "model_name").select(
        "model_name", "problem_id", "title", "trial_index", "accepted", "width"
    )


def trial_matrix_wide(matrix: DataFrame, width: int) -> DataFrame:
    """``trial_matrix`` with one 0/1 column per trial index, padded with 0."""
    return (
        matrix.groupBy("model_name", "problem_id", "title")
        .pivot("trial_index", list(range(width)))
        .max("accepted")
        .na.fill(0)
    )


def success_counts(cells: DataFrame, strategy: str = "detailed") -> DataFrame:
    """Problems per number of accepted attempts, 0 up to the longest cell of the model."""
    rows = cells.where(F.col("strategy") == strategy)
    # Counted out in two steps, so that no array is as long as the longest cell.
    step = 1 << 16
    longest = rows.groupBy("model_name").agg(F.max("n").alias("longest"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("longest") / step))
    spans = longest.select("model_name", "longest", F.explode(parts).alias("part"))
    low = F.col("part") * step
    own = F.sequence(low, F.least(low + step - 1, F.col("longest")))
    grid = spans.select("model_name", F.explode(own).alias("successes"))
    found = rows.groupBy("model_name", F.col("a").alias("successes")).agg(F.count(F.lit(1)).alias("problems"))
    return grid.join(found, ["model_name", "successes"], "left").fillna(0, ["problems"])


def prompt_metrics_long(totals: DataFrame) -> DataFrame:
    """(model, prompt, metric, value) rows of the two rates that the prompt figure compares."""
    return (
        totals.withColumnRenamed("first_pass_accuracy", "First-Pass Accuracy")
        .withColumnRenamed("perfect_stability_rate", "Perfect Stability Rate")
        .unpivot(
            ["model_name", F.initcap("strategy").alias("prompt")],
            ["First-Pass Accuracy", "Perfect Stability Rate"],
            "metric",
            "value",
        )
    )
