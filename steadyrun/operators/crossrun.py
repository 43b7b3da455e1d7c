"""Summaries over runs: dedupe, leaderboards, figure frames, prompt and model comparisons.

Tables here have one row per summary, configuration, or (model, problem).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyrun.functions import labels, render, stats
from steadyrun.functions.spread import join_groups, positions, ranks, running_totals
from steadyrun.operators import problems as prob
from steadyrun.operators.stability import first_per_key

# What makes two summaries the same configuration, and which ones a paper may use.
CONFIG_KEY = [
    "model_name", "prompt_type", "dataset", "num_problems", "stability_runs", "generation_mode",
    "temperature", "top_p", "max_tokens",
]
PAPER_MODES = [
    "realtime", "qwen_batch", "openai_batch", "anthropic_batch", "gemini_batch", "azure_batch",
    "bedrock_batch",
]
PAPER_MIN_PROBLEMS = 10
PAPER_MIN_RUNS = 3

# Leaderboard columns and their titles, in display order.
LEADERBOARD = {
    "model_name": "Model",
    "prompt_type": "Prompt",
    "dataset": "Dataset",
    "num_problems": "Num Problems",
    "stability_runs": "Stability Runs",
    "generation_mode": "Generation Mode",
    "run_level_pass_rate": "Run-Level Pass Rate",
    "first_pass_accuracy": "First-Pass Accuracy",
    "perfect_stability_rate": "Perfect Stability Rate",
    "average_variance": "Average Variance",
    "run_level_ci_95": "RLPR 95% CI",
    "first_pass_ci_95": "FPA 95% CI",
    "perfect_stability_ci_95": "PSR 95% CI",
    "average_variance_ci_95": "AV 95% CI",
    "p90_latency_ms": "p90 Latency",
}
SUMMARY_DECIMALS = {
    "run_level_pass_rate": 2, "first_pass_accuracy": 2, "perfect_stability_rate": 2,
    "average_variance": 4, "p50_latency_ms": 2, "p90_latency_ms": 2,
    "pass_at_1": 2, "pass_at_3": 2, "pass_at_5": 2,
}
CI_DECIMALS = {
    "run_level_ci_95": 2, "first_pass_ci_95": 2, "perfect_stability_ci_95": 2,
    "average_variance_ci_95": 4,
}

# Labels of the success buckets and their upper ends.
SUCCESS_BUCKETS = [
    ("0/5", 0.01), ("1/5", 0.21), ("2/5", 0.41), ("3/5", 0.61), ("4/5", 0.81), ("5/5", 1.01),
]


def load_summaries(summaries: DataFrame) -> DataFrame:
    """Prompt-specific summaries; a missing generation mode counts as realtime."""
    return summaries.where(F.col("prompt_type").isin("detailed", "minimal")).withColumn(
        "generation_mode", F.coalesce("generation_mode", F.lit("realtime"))
    )


def sort_key(experiment_name: Column) -> Column:
    """The leading time stamp of an experiment name, or all of it."""
    stamp = F.regexp_extract(experiment_name, r"^(\d{8}_\d{6})", 1)
    return F.coalesce(F.when(stamp != "", stamp), experiment_name, F.lit(""))


def dedupe_summaries(summaries: DataFrame, arrival: str = "seq") -> DataFrame:
    """The latest summary of each configuration; of equal ones the first to arrive."""
    return first_per_key(
        summaries, CONFIG_KEY, [F.desc(sort_key(F.col("experiment_name"))), F.col(arrival)]
    )


def paper_eligible(summaries: DataFrame) -> DataFrame:
    return summaries.where(
        (F.col("dataset") == "main")
        & F.col("generation_mode").isin(*PAPER_MODES)
        & (F.col("num_problems") >= PAPER_MIN_PROBLEMS)
        & (F.col("stability_runs") >= PAPER_MIN_RUNS)
    )


def paper_models(summaries: DataFrame) -> DataFrame:
    """Models with an eligible detailed summary: (model_name, best_rlpr)."""
    rows = paper_eligible(dedupe_summaries(load_summaries(summaries)))
    return (
        rows.where(F.col("prompt_type") == "detailed")
        .groupBy("model_name")
        .agg(F.max("run_level_pass_rate").alias("best_rlpr"))
    )


def with_settings(summary: DataFrame, summaries: DataFrame) -> DataFrame:
    """``summary`` rows (model_name, prompt_type, ...) with the run settings a board shows, from the latest of the
    ``summaries`` of the same model and prompt; null where there is none."""
    names = ["dataset", "num_problems", "stability_runs", "generation_mode"]
    order = F.struct(sort_key(F.col("experiment_name")).alias("key"), (-F.col("seq")).alias("seq"))
    latest = load_summaries(summaries).groupBy("model_name", "prompt_type").agg(F.max_by(F.struct(*names), order).alias("of"))
    return join_groups(summary, latest, ["model_name", "prompt_type"], "left").select(
        *summary.columns, *[F.col(f"of.{c}").alias(c) for c in names]
    )


def ranked(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], name: str) -> DataFrame:
    """1-based position by descending ``score``."""
    return positions(df, keys, [F.desc_nulls_last(score), *[F.col(t) for t in ties]], name)


def round_summary(summary: DataFrame) -> DataFrame:
    """Fixed decimals of a stored summary row."""
    out = {c: stats.rounded(F.col(c), d) for c, d in SUMMARY_DECIMALS.items() if c in summary.columns}
    for c, d in CI_DECIMALS.items():
        if c in summary.columns:
            lo, hi = (stats.rounded(F.col(f"{c}.{side}"), d).alias(side) for side in ("lo", "hi"))
            out[c] = F.struct(lo, hi)
    return summary.withColumns(out)


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Display columns that the data has, best run-level pass rate first by ``row_no``."""
    rows = ranked(
        round_summary(summaries), [], "run_level_pass_rate",
        [c for c in CONFIG_KEY if c in summaries.columns], "row_no",
    )
    out = [F.col("row_no")]
    for c, title in LEADERBOARD.items():
        if c in CI_DECIMALS and c in rows.columns:
            lo, hi = (render.number_text(F.col(f"{c}.{side}"), CI_DECIMALS[c]) for side in ("lo", "hi"))
            out.append(F.coalesce(F.concat(F.lit("["), lo, F.lit(", "), hi, F.lit("]")), F.lit("")).alias(title))
        elif c in rows.columns:
            out.append(F.col(c).alias(title))
    return rows.select(*out)


def _cells(board: DataFrame) -> list[Column]:
    """Leaderboard columns as text; doubles as short decimals."""
    decimals = {LEADERBOARD[c]: d for c, d in SUMMARY_DECIMALS.items() if c in LEADERBOARD}
    return [
        render.number_text(F.col(f"`{c}`"), decimals[c]) if c in decimals else F.col(f"`{c}`")
        for c in board.columns
        if c != "row_no"
    ]


def leaderboard_markdown(board: DataFrame, title: str | None = None, note: str | None = None) -> DataFrame:
    """The lines of the table, after a heading and a line of text where given."""
    names = [c for c in board.columns if c != "row_no"]
    above = [line for text in (title and f"# {title}", note and f"_{note}_") if text for line in (text, "")]
    return render.table_lines(board, render.markdown_row(_cells(board)), [*above, *render.markdown_head(names)])


def leaderboard_document(board: DataFrame, filters: dict | None = None) -> DataFrame:
    """The board as one JSON document: num_rows, columns, rows and, where given, filters.

    A board has a row per configuration, so the document is small.
    """
    names = [c for c in board.columns if c != "row_no"]
    row = F.struct("row_no", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
    parts = board.agg(F.count(F.lit(1)).alias("n"), F.to_json(rows).alias("rows"))
    tail = f', "filters": {json.dumps(filters)}' if filters else ""
    head = F.concat(F.lit('{"num_rows": '), F.col("n").cast("string"), F.lit(f', "columns": {json.dumps(names)}, "rows": '))
    return parts.select(F.concat(head, F.col("rows"), F.lit(tail + "}")).alias("value"))


PAPER_FILTERS = {
    "dataset": "main", "min_num_problems": PAPER_MIN_PROBLEMS, "min_stability_runs": PAPER_MIN_RUNS,
    "generation_modes": sorted(PAPER_MODES),
}
PAPER_NOTE = (
    f"Filters: dataset=`main`, num_problems>={PAPER_MIN_PROBLEMS}, stability_runs>={PAPER_MIN_RUNS}, "
    f"generation_mode in {sorted(PAPER_MODES)}."
)


def leaderboard_latex(board: DataFrame) -> DataFrame:
    names = [c for c in board.columns if c != "row_no"]
    return render.table_lines(
        board, render.latex_row(_cells(board)), render.latex_head(names), render.LATEX_FOOT
    )


def gaps(configs: DataFrame) -> DataFrame:
    """Accuracy-stability gap per configuration, with the extremes marked."""
    gap = F.col("rlpr") - F.col("psr")
    ends = configs.agg(F.struct(F.max(gap).alias("hi"), F.min(gap).alias("lo")).alias("e")).scalar()
    return (
        configs.withColumn("gap", gap)
        .withColumn("__ends", ends)
        .withColumns(
            {
                "is_largest": F.col("gap") == F.col("__ends.hi"),
                "is_smallest": F.col("gap") == F.col("__ends.lo"),
            }
        )
        .drop("__ends")
    )


def model_means(configs: DataFrame) -> DataFrame:
    """Mean over prompts per model."""
    return configs.groupBy("model_name").agg(
        F.avg("rlpr").alias("rlpr"),
        F.avg("psr").alias("psr"),
        F.avg(F.col("rlpr") - F.col("psr")).alias("gap"),
        F.avg("av").alias("av"),
        F.first("is_reasoning").alias("is_reasoning"),
    )


def av_by_type(configs: DataFrame) -> DataFrame:
    """Mean of the model-level average variance per kind of model."""
    return model_means(configs).groupBy("is_reasoning").agg(
        F.avg("av").alias("mean_av"), F.count(F.lit(1)).alias("models")
    )


def prompt_pairs(configs: DataFrame) -> DataFrame:
    """Both prompts of a model side by side; a side is null where the model lacks it."""

    def side(prompt: str, col: str) -> Column:
        return F.max(F.when(F.col("prompt_type") == prompt, F.col(col)))

    return configs.groupBy("model_name").agg(
        *[side(p, c).alias(f"{p}_{c}") for p in ("detailed", "minimal") for c in ("rlpr", "psr", "av")]
    )


def prompt_winners(configs: DataFrame) -> DataFrame:
    """How many models do better under each prompt by PSR, and the mean absolute difference."""
    d, m = F.col("detailed_psr"), F.col("minimal_psr")
    return prompt_pairs(configs).agg(
        F.count_if(d > m).alias("detailed_wins"),
        F.count_if(m > d).alias("minimal_wins"),
        F.count_if(d == m).alias("ties"),
        F.avg(F.abs(d - m)).alias("mean_abs_difference"),
    )


def dominating(points: DataFrame, keys: Sequence[str], low: str, high: str, name: str) -> DataFrame:
    """How many rows of the same ``keys`` are below a point in ``low`` and above it in ``high``, as ``name``.

    One row per distinct point (keys, low, high); rows with a null value count nowhere. Points are ranked by
    ``high``, and two ranks differ first at one bit: at each bit, points that agree in the bits above are put in
    order of ``low``, and one with the lower bit counts the others before it. That is a running total per bit, so
    n log n rows and no pairs.
    """
    held = points.where(F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(*keys, low, high)
    held = ranks(held.agg(F.count(F.lit(1)).alias("__m")), keys, high, ("__rank", "__dense"))
    most = held.agg(F.coalesce(F.max("__dense"), F.lit(0))).first()[0]
    bits = max(1, int(most).bit_length())
    rows = held.withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    rows = rows.withColumns(
        {"__above": F.expr("shiftright(__dense, __level + 1)"), "__bit": F.expr("shiftright(__dense, __level) & 1")}
    )
    # The first rank is the highest, so it is the set bit that counts the others; it goes first among equals.
    better = F.when(F.col("__bit") == 0, F.col("__m")).otherwise(F.lit(0))
    total = running_totals(rows, [*keys, "__level", "__above"], [F.col(low), F.desc("__bit")], {"__n": better})
    return total.groupBy(*keys, low, high).agg(F.sum(F.when(F.col("__bit") == 1, F.col("__n")).otherwise(0)).alias(name))


def rank_reversals(configs: DataFrame) -> DataFrame:
    """Configurations that some configuration of the same prompt beats in PSR despite a lower RLPR.

    Each is reported once, with the number of such rivals and the strongest of them, found in one sorted pass per
    prompt; the pairs themselves are never built.
    """
    # The best up to and with each rate, then the one of the next lower rate; equal rates share it.
    rates = configs.groupBy("prompt_type", "rlpr").agg(F.max(F.struct("psr", "model_name", "rlpr")).alias("top"))
    lower = Window.partitionBy("prompt_type").orderBy("rlpr").rowsBetween(Window.unboundedPreceding, -1)
    below = rates.select("prompt_type", "rlpr", F.max("top").over(lower).alias("rival"))
    beaten = (
        configs.join(below, ["prompt_type", "rlpr"])
        .where(F.col("rival.psr") > F.col("psr"))
        .select(
            "prompt_type", "model_name", "rlpr", "psr",
            F.col("rival.model_name").alias("rival"),
            F.col("rival.rlpr").alias("rival_rlpr"),
            F.col("rival.psr").alias("rival_psr"),
        )
    )
    counts = dominating(configs, ["prompt_type"], "rlpr", "psr", "reversals")
    return beaten.join(counts, ["prompt_type", "rlpr", "psr"])


def model_rank(configs: DataFrame) -> DataFrame:
    """Rank of each model by RLPR and by PSR within its prompt."""

    by_rlpr = ranks(configs.select("prompt_type", "model_name", "rlpr", "psr"), ["prompt_type"], "rlpr", ("rlpr_rank", "rlpr_dense_rank"))
    by_both = ranks(by_rlpr, ["prompt_type"], "psr", ("psr_rank", "psr_dense_rank"))
    return by_both.select(
        "prompt_type", "model_name", *[F.col(c).cast("int").alias(c) for c in ("rlpr_rank", "rlpr_dense_rank", "psr_rank")]
    )


def stability_heatmap(trials: DataFrame, problems: DataFrame, models: DataFrame) -> DataFrame:
    """Mean pass rate per (model, problem) of the detailed prompt, with grid positions.

    Rows go by the model's best RLPR; columns by tier, then mean rate over all models (a model
    with no attempt counts 0), then a hash of the problem id. A (model, problem) with no row is 0.
    """
    # The filter is the one the last join implies; stated here, it holds for all branches alike.
    kept = trials.where((F.col("strategy") == "detailed") & F.col("problem_id").isNotNull())
    kept = kept.join(models, "model_name", "left_semi")
    rates = kept.groupBy("model_name", "problem_id").agg(F.avg("accepted").alias("rate"))
    # Asking for the mean keeps the rates in this branch, so all branches share one shuffle.
    means = rates.groupBy("model_name").agg(F.avg("rate").alias("mean"))
    present = means.where(F.col("mean").isNotNull()).select("model_name")
    rows = ranked(models.join(present, "model_name", "left_semi"), [], "best_rlpr", ["model_name"], "row_pos")
    columns = rates.groupBy("problem_id").agg(F.sum("rate").alias("rate"))
    columns = columns.withColumn(
        "mean_rate", F.col("rate") / present.agg(F.count(F.lit(1))).scalar()
    ).drop("rate")
    columns = prob.with_difficulty(columns, problems).withColumn(
        "tier", prob.tier_order(F.col("difficulty"))
    )
    # Sums of the same rates in another order may differ in the last bits; such rates are equal here.
    order = [F.col("tier"), F.desc(F.round("mean_rate", 9)), F.substring(F.md5("problem_id"), 1, 3), F.col("problem_id")]
    columns = positions(columns, [], order, "col_pos")
    return rates.join(rows.select("model_name", "row_pos"), "model_name").join(
        columns.select("problem_id", "tier", "mean_rate", "col_pos"), "problem_id"
    )


def tier_boundaries(columns: DataFrame) -> DataFrame:
    """First 0-based column of every tier after the first. Needs (problem_id, tier) rows."""
    sizes = columns.groupBy("tier").agg(F.count(F.lit(1)).alias("size"))
    # At most four tiers reach this window.
    before = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "tier", "size", F.sum("size").over(before).alias("boundary")
    ).where(F.col("boundary").isNotNull())


def success_buckets(trials: DataFrame, by_model: bool = False) -> DataFrame:
    """Problems per band of mean pass rate, pooled over models or per model, empty bands kept."""
    by = ["model_name"] if by_model else []
    rate = F.round(F.avg("accepted"), 4)
    rates = trials.where(F.col("strategy") == "detailed").groupBy(*by, "problem_id").agg(rate.alias("rate"))
    bucket = F.lit(None).cast("string")
    for label, upper in reversed(SUCCESS_BUCKETS):
        bucket = F.when(F.col("rate") <= upper, F.lit(label)).otherwise(bucket)
    found = rates.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("problems"))
    all_labels = F.explode(F.array(*[F.lit(label) for label, _ in SUCCESS_BUCKETS])).alias("bucket")
    if by:
        grid = rates.select(*by).distinct().select(*by, all_labels)
    else:
        grid = trials.sparkSession.range(1).select(all_labels)
    return grid.join(found, [*by, "bucket"], "left").fillna(0, ["problems"])


def prompt_bars(summary: DataFrame) -> DataFrame:
    """Bars with error lengths for RLPR and PSR, models ordered by their best RLPR."""
    order = ranked(
        summary.groupBy("model_name").agg(F.max("run_level_pass_rate").alias("best")),
        [], "best", ["model_name"], "model_pos",
    )

    def bar(metric: str, ci: str) -> Column:
        v = F.coalesce(metric, F.lit(0.0))
        return F.struct(
            F.lit(metric).alias("metric"),
            v.alias("value"),
            F.coalesce(F.greatest(F.lit(0.0), v - F.col(f"{ci}.lo")), F.lit(0.0)).alias("lower_err"),
            F.coalesce(F.greatest(F.lit(0.0), F.col(f"{ci}.hi") - v), F.lit(0.0)).alias("upper_err"),
        )

    bars = F.array(
        bar("run_level_pass_rate", "run_level_ci_95"),
        bar("perfect_stability_rate", "perfect_stability_ci_95"),
    )
    return (
        summary.select("model_name", "prompt_type", F.inline(bars))
        .join(order.select("model_name", "model_pos"), "model_name")
    )


def accuracy_stability(summaries: DataFrame) -> DataFrame:
    """Points of the accuracy-stability figure, marked where paper-eligible."""
    eligible = (
        (F.col("dataset") == "main")
        & F.col("generation_mode").isin(*PAPER_MODES)
        & (F.col("num_problems") >= PAPER_MIN_PROBLEMS)
        & (F.col("stability_runs") >= PAPER_MIN_RUNS)
    )
    return summaries.select(
        "experiment_name", "model_name", "prompt_type", "run_level_pass_rate", "perfect_stability_rate",
        F.coalesce(eligible, F.lit(False)).alias("paper_eligible"),
    )


def needs_retry() -> Column:
    """Aggregate: whether any attempt never reached the judge."""
    lost = F.col("submission_id").isNull() & (F.col("status") == "Submission Failed")
    return F.bool_or(F.coalesce(lost, F.lit(False)))


def retry_problems(trials: DataFrame) -> DataFrame:
    """(model, problem) items with their need for a retry."""
    return trials.groupBy("model_name", "problem_id").agg(needs_retry().alias("needs_retry"))


def retry_from_arrays(results: DataFrame) -> DataFrame:
    """The same on nested results."""

    def lost(a: Column) -> Column:
        return a.submission_id.isNull() & (a.status == "Submission Failed")

    return results.withColumn(
        "needs_retry", F.exists("with_prompt", lost) | F.exists("without_prompt", lost)
    )


def coverage(trials: DataFrame) -> DataFrame:
    """Problems with nothing to retry, against all, per model."""
    return retry_problems(trials).groupBy("model_name").agg(
        F.count_if(~F.col("needs_retry")).alias("covered"), F.count(F.lit(1)).alias("total")
    )


def resume_pending(items: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items not yet complete in earlier results."""
    done = results.where(~F.col("needs_retry")).select(*key)
    return items.join(done, list(key), "left_anti")


def latest_state(events: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Last known value of ``cols`` per key; one row per key and map task is shuffled."""
    rows = first_per_key(events, key, [F.desc("ts"), F.desc("event_id")])
    return rows.select(*key, *cols)


def model_readiness(
    jobs: DataFrame, evaluations: DataFrame, done: Sequence[str] = ("completed", "job_state_succeeded")
) -> DataFrame:
    """Five readiness states per model from the latest job of each prompt and the evaluation state."""
    latest = latest_state(jobs, ["model_id", "prompt_type"], ["status", "normalized_exists"])
    ready = F.lower("status").isin(*done) & F.col("normalized_exists")

    def side(prompt: str) -> Column:
        return F.coalesce(F.bool_or((F.col("prompt_type") == prompt) & ready), F.lit(False))

    sides = latest.groupBy("model_id").agg(
        side("detailed").alias("detailed_ready"), side("minimal").alias("minimal_ready")
    )
    state = latest_state(evaluations, ["model_id"], ["evaluation_state"])
    d, m = F.col("detailed_ready"), F.col("minimal_ready")
    return (
        sides.join(state, "model_id", "full")
        .fillna(False, ["detailed_ready", "minimal_ready"])
        .withColumn(
            "ready_state",
            F.when(F.col("evaluation_state") == "completed", F.lit("EVALUATION_COMPLETED"))
            .when(d & m, F.lit("READY_FOR_SUBMISSION"))
            .when(d, F.lit("WAITING_FOR_MINIMAL"))
            .when(m, F.lit("WAITING_FOR_DETAILED"))
            .otherwise(F.lit("WAITING_FOR_BOTH")),
        )
    )


def readiness_counts(readiness: DataFrame) -> DataFrame:
    state = F.col("ready_state")
    done, ready = state == "EVALUATION_COMPLETED", state == "READY_FOR_SUBMISSION"
    return readiness.agg(
        F.count_if(ready).alias("ready_models"),
        F.count_if(done).alias("completed_models"),
        F.count_if(~ready & ~done).alias("pending_models"),
    )


def experiment_outcomes(experiments: DataFrame) -> DataFrame:
    return experiments.agg(
        F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed")
    )


def failed_attempts(submissions: DataFrame) -> DataFrame:
    """Failed attempts with the number of successes before them (which names their run) and their
    number among the account's failures. Attempts that had no code to submit are ignored.

    Both are running totals over ranges of the attempts' order, so an account with most of the attempts, or an
    hour with most of an account's, is still many tasks.
    """
    ok = F.col("submission_id").isNotNull().cast("bigint")
    counted = running_totals(
        submissions.where("has_code"),
        ["account"],
        [F.col("ts"), F.col("event_id")],
        {"successes_before": ok, "failure_no": 1 - ok},
    )
    return counted.where(F.col("submission_id").isNull())


def failure_runs(submissions: DataFrame, threshold: int = 10) -> DataFrame:
    """Runs of consecutive failed submissions per account; a success ends a run."""
    at = F.struct("ts", "event_id")
    return (
        failed_attempts(submissions)
        .groupBy("account", "successes_before")
        .agg(
            F.count(F.lit(1)).alias("run_length"),
            F.min(at).event_id.alias("first_event"),
            F.max(at).event_id.alias("last_event"),
        )
        .withColumn("breached", F.col("run_length") >= threshold)
    )


def ranked_model_trials(trials: DataFrame, models: DataFrame) -> DataFrame:
    """Attempts of the listed models."""
    return trials.join(models.select("model_name"), "model_name", "left_semi")


def report_config(metrics: DataFrame, experiments: DataFrame) -> DataFrame:
    """Metrics joined to the settings of the latest experiment of the same model and prompt."""
    latest = first_per_key(
        experiments,
        ["model_name", "prompt_type"],
        [F.desc(sort_key(F.col("experiment_name"))), F.col("seq")],
    )
    settings = latest.select(
        "model_name", "prompt_type", "experiment_name", "dataset", "generation_mode", "temperature",
        "top_p", "max_tokens",
    )
    return metrics.join(settings, ["model_name", "prompt_type"], "left")
