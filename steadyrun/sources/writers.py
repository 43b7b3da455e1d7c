"""Sinks. All writes are distributed; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.operators import crossrun
from steadyrun.sources.scratch import stored


def write_trials(trials: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append attempts, one directory per model so that later reads can skip models."""
    trials.write.mode("append").partitionBy("model_name").format(fmt).save(path)


def write_trial_table(trials: DataFrame, name: str, path: str | None = None, buckets: int = 16) -> None:
    """Append attempts to the table ``name``, one partition per model, in buckets of problem and strategy.

    Cells of a model are then counted without moving an attempt, and a filter on the model reads its partition
    only. ``path`` is where a new table lies (the warehouse, if not given). A bucket is written by up to eight
    tasks, by the trial's index, as one cell may have many of all attempts.
    """
    salt = F.pmod(F.coalesce(F.col("trial_index"), F.lit(0)), F.lit(8))
    out = trials.repartition(buckets, "problem_id", "strategy", salt).write.mode("append").format("parquet")
    out = out.partitionBy("model_name").bucketBy(buckets, "problem_id", "strategy")
    (out.option("path", path) if path else out).saveAsTable(name)


def request_line(body: Column) -> Column:
    """One request as ASCII-only JSON."""
    return F.to_json(body, {"writeNonAsciiCharacterAsCodePoint": "true", "ignoreNullFields": "true"})


def write_requests(requests: DataFrame, path: str, body: str = "request") -> None:
    requests.select(request_line(F.col(body))).write.mode("overwrite").text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON object per line, so that reading splits the files. ``read_manifest_lines`` reads it."""
    manifest.write.mode("overwrite").json(path)


def attempt_summary(trials: DataFrame) -> DataFrame:
    """The eleven display columns of the attempt table."""

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint").cast("string")

    return trials.select(
        F.col("timestamp").alias("Timestamp"),
        F.col("title").alias("Problem"),
        F.col("difficulty").alias("Difficulty"),
        F.col("model_name").alias("Model"),
        F.col("strategy").alias("Strategy"),
        F.col("status").alias("Status"),
        F.col("runtime").alias("Runtime(ms)"),
        F.col("memory").alias("Memory(MB)"),
        (F.coalesce("latency_ms", F.lit(0.0)) / 1000).alias("Gen Time(s)"),
        F.concat(number("input_tokens"), F.lit("/"), number("output_tokens")).alias("Tokens(In/Out)"),
        F.coalesce("cost", F.lit(0.0)).alias("Est Cost($)"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def solution_block(title: Column, strategy: Column, code: Column) -> Column:
    """A Markdown section holding one answer's code."""
    body = F.coalesce(F.nullif(code, F.lit("")), F.lit("# No code generated"))
    return F.concat(
        F.lit("## "), title, F.lit(" ("), strategy, F.lit(")\n```python\n"), body, F.lit("\n```\n\n")
    )


def write_solutions(solutions: DataFrame, path: str) -> None:
    """``solutions`` has a text column ``block``; its last line break is the one the sink writes."""
    block = F.regexp_replace("block", r"\n\z", "")
    solutions.select(block.alias("block")).write.mode("overwrite").text(path)


def write_leaderboard(summaries: DataFrame, path: str) -> None:
    """General and paper-eligible boards as CSV, JSON, Markdown and LaTeX under ``path``.

    Each board is computed once and its four forms are written from that.
    """
    kinds = {"leaderboard": (summaries, "Performance of all configurations", None, None)}
    if {"dataset", "generation_mode", "num_problems", "stability_runs"} <= set(summaries.columns):
        kinds["paper_leaderboard"] = (
            crossrun.paper_eligible(summaries), "Performance of paper-eligible configurations",
            crossrun.PAPER_NOTE, crossrun.PAPER_FILTERS,
        )
    for kind, (rows, title, note, filters) in kinds.items():
        board = stored(crossrun.leaderboard(rows), kind)
        write_csv(board.orderBy("row_no").drop("row_no"), f"{path}/{kind}.csv")
        crossrun.leaderboard_document(board, filters).write.mode("overwrite").text(f"{path}/{kind}.json")
        for name, lines in (
            ("md", crossrun.leaderboard_markdown(board, title, note)),
            ("tex", crossrun.leaderboard_latex(board)),
        ):
            lines.orderBy("line_no").select("line").write.mode("overwrite").text(f"{path}/{kind}.{name}")


def save_summary(summary: DataFrame, path: str) -> None:
    """Rounded summary rows; an experiment written again replaces its own directory only."""
    out = crossrun.round_summary(summary)
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("experiment_name")
        .parquet(path)
    )
