"""Inputs shared by the queries, and the same inputs as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyrun.operators import stability
from steadyrun.sources.tables import VIEWS, view

# Log order: the earliest entry of an attempt stands for it; the rest only breaks ties.
LOG_ORDER = ["logged_at", *[f"tie_{i}" for i in range(1, 8)]]


def trial_log(spark: SparkSession, sf: str) -> DataFrame:
    return stability.with_labels(view(spark, sf, "v_trial_log"))


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with clean labels, each counted once."""
    return stability.dedupe_trials(trial_log(spark, sf), [F.col(c) for c in LOG_ORDER])


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return stability.cells(trials(spark, sf))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Cells without the ordinal of the first accepted trial, which most queries do not need."""
    return stability.cell_counts(trials(spark, sf))


def configs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (model, prompt): rates and average variance, with the kind of model."""
    totals = stability.cell_totals(counts(spark, sf), ["model_name", "strategy"], ks=())
    return totals.select(
        "model_name",
        F.col("strategy").alias("prompt_type"),
        F.col("run_level_pass_rate").alias("rlpr"),
        F.col("perfect_stability_rate").alias("psr"),
        F.col("average_variance").alias("av"),
        (F.substring_index("model_name", "-", -1).cast("int") % 3 == 0).alias("is_reasoning"),
    )


# SQL for the same inputs.
STRATEGY_SQL = """case coalesce(nullif(strategy, ''), nullif(prompt_type, ''), 'default')
  when 'with_prompt' then 'detailed' when 'without_prompt' then 'minimal'
  else coalesce(nullif(strategy, ''), nullif(prompt_type, ''), 'default') end"""

STEPS = dict(VIEWS)
STEPS["log"] = f"""
select * exclude (strategy), {STRATEGY_SQL} as strategy,
       case when status = 'Accepted' then 1 else 0 end as accepted
from v_trial_log
"""
STEPS["trials"] = f"""
select * exclude (rn) from (
  select *, row_number() over (partition by model_name, problem_id, strategy, trial_index
                               order by {", ".join(LOG_ORDER)}) as rn from log) t
where rn = 1
"""
STEPS["cells"] = """
select model_name, problem_id, strategy, count(*) as n, cast(sum(accepted) as bigint) as a,
       coalesce(max(case when trial_index = 0 then accepted end), 0) as first_pass,
       coalesce(min(case when accepted = 1 then ord end), 0) as first_accepted,
       count(*) filter (where latency_ms <> 0) as latencies
from (select *, row_number() over (partition by model_name, problem_id, strategy order by trial_index) as ord
      from trials) t
group by model_name, problem_id, strategy
"""
STEPS["configs"] = """
select model_name, strategy as prompt_type,
       cast(sum(a) as double) * 100.0 / cast(sum(n) as double) as rlpr,
       cast(count(*) filter (where a = n) as double) * 100.0 / cast(count(*) as double) as psr,
       avg((a / n) * (1 - a / n)) as av,
       cast(split_part(model_name, '-', 2) as int) % 3 = 0 as is_reasoning
from cells group by model_name, strategy
"""


def sql(body: str) -> str:
    """``body`` with every named step it reads put in front as a common table expression."""
    done: list[str] = []

    def need(text: str) -> None:
        for name, step in STEPS.items():
            if name not in done and re.search(rf"(?:from|join)\s+{name}\b", text):
                # A recursive step reads itself.
                need(re.sub(rf"\b{name}\b", "", step))
                done.append(name)

    need(body)
    extra = body.strip()
    if not done:
        return extra
    head = ", ".join(f"{name} as ({STEPS[name].strip()})" for name in done)
    if extra.lower().startswith("with "):
        return f"with {head}, {extra[5:]}"
    return f"with {head} {extra}"
