"""Cells and repeated-run metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from steadyrun.functions import sql as sql_functions
from steadyrun.operators import inference, stability
from steadyrun.plans.common import STEPS, cells, counts, sql, trial_log, trials
from steadyrun.sources.scratch import stored
from steadyrun.sources.tables import view

QUERIES = {}

BY = ["model_name", "strategy"]
RATES = """
       count(*) as total_problems, cast(sum(n) as bigint) as total_runs, cast(sum(a) as bigint) as accepted_runs,
       count(*) filter (where a = n) as stable_problems, cast(sum(first_pass) as bigint) as first_pass_problems,
       cast(sum(a) as double) * 100.0 / cast(sum(n) as double) as run_level_pass_rate,
       cast(count(*) filter (where a = n) as double) * 100.0 / cast(count(*) as double) as perfect_stability_rate,
       cast(sum(first_pass) as double) * 100.0 / cast(count(*) as double) as first_pass_accuracy,
       round(avg((a / n) * (1 - a / n)), 9) as average_variance,
       cast(count(*) filter (where first_accepted between 1 and 1) as double) * 100.0 / cast(count(*) as double) as pass_at_1,
       cast(count(*) filter (where first_accepted between 1 and 3) as double) * 100.0 / cast(count(*) as double) as pass_at_3,
       cast(count(*) filter (where first_accepted between 1 and 5) as double) * 100.0 / cast(count(*) as double) as pass_at_5
"""
RATE_COLUMNS = [
    "total_problems", "total_runs", "accepted_runs", "stable_problems", "first_pass_problems",
    "run_level_pass_rate", "perfect_stability_rate", "first_pass_accuracy",
    "average_variance", "pass_at_1", "pass_at_3", "pass_at_5",
]
CI = [("run_level", "accepted_runs", "total_runs"), ("first_pass", "first_pass_problems", "total_problems"),
      ("perfect_stability", "stable_problems", "total_problems")]


def rates(df):
    return df.select(*[c for c in df.columns if c in BY], *RATE_COLUMNS).withColumn(
        "average_variance", F.round("average_variance", 9)
    )


def wilson_sql(s: str, n: str, side: str, decimals: int = 6) -> str:
    sign, pick, limit = ("-", "greatest", "0.0") if side == "lo" else ("+", "least", "1.0")
    p, z2 = f"(cast({s} as double) / {n})", "(1.96e0 * 1.96e0)"
    centre = f"({p} + {z2} / (2.0 * {n}))"
    spread = f"(1.96e0 * sqrt(({p} * (1.0 - {p}) + {z2} / (4.0 * {n})) / {n}))"
    return f"round({pick}({limit}, ({centre} {sign} {spread}) / (1.0 + {z2} / {n})) * 100.0, {decimals})"


CI_SQL = ", ".join(
    f"{wilson_sql(part, whole, side)} as {name}_{side}" for name, part, whole in CI for side in ("lo", "hi")
)


def intervals(df):
    """Interval structs as rounded flat columns."""
    flat = {
        f"{name}_{side}": F.round(F.col(f"{name}_ci_95.{side}"), 6)
        for name, _, _ in CI
        for side in ("lo", "hi")
    }
    return df.withColumns(flat).drop(*[f"{name}_ci_95" for name, _, _ in CI])


def summary_rows(spark, sf):
    """The full summary row of every model and prompt, unrounded; attempts and cells are written once."""
    log = stored(trials(spark, sf).select(*stability.TRIAL_KEY, "accepted", "latency_ms"), "attempts")
    found = stored(stability.cells(log), "cells")
    return inference.with_variance_interval(stability.stability_summary(log, BY, found), found, BY)


def summary(spark, sf):
    out = intervals(summary_rows(spark, sf))
    av = {f"average_variance_{s}": F.round(F.col(f"average_variance_ci_95.{s}"), 9) for s in ("lo", "hi")}
    return out.withColumns(av).drop("average_variance_unbiased", "average_variance_ci_95").withColumns(
        {
            "average_variance": F.round("average_variance", 9),
            "p50_latency_ms": F.round("p50_latency_ms", 6),
            "p90_latency_ms": F.round("p90_latency_ms", 6),
        }
    )


LATENCY_SQL = """select model_name, strategy, round(quantile_cont(latency_ms, 0.5), 6) as p50_latency_ms,
       round(quantile_cont(latency_ms, 0.9), 6) as p90_latency_ms
from trials where latency_ms <> 0 group by model_name, strategy"""

# The bootstrap of the average variance: the distinct values of a group are the leaves of a tree, and every
# replicate's draws are split from the top by one binomial draw per node.
STEPS["variances"] = """
select model_name, strategy, v, count(*) as n, row_number() over (partition by model_name, strategy order by v) - 1 as place
from (select model_name, strategy, (a / n) * (1 - a / n) as v from cells) c group by model_name, strategy, v
"""
STEPS["tree"] = """
select model_name, strategy, level, place >> (depth - level) as node, sum(n) as whole,
       coalesce(sum(n) filter (where (place >> (depth - 1 - level)) & 1 = 0), 0) as first
from variances, (select unnest(range(0, length(bin(max(place))))) as level, length(bin(max(place))) as depth
                 from variances having max(place) > 0) levels
group by all
"""
_UNIFORM = "(cast(concat('0x', substring(h, {at}, 12)) as bigint) + 0.5e0) / 281474976710656.0e0"
STEPS["draws"] = f"""
select model_name, strategy, replicate, 0 as level, cast(0 as bigint) as node, cast(n as bigint) as drawn, cast(n as bigint) as cells
from (select model_name, strategy, sum(n) as n from variances group by all) g, (select unnest(range(0, 1000)) as replicate) r
union all
select model_name, strategy, replicate, level + 1, node * 2 + side, case when side = 0 then k else drawn - k end, cells
from (
  select *, case when 2 * first > whole then drawn - least(drawn, rare) else least(drawn, rare) end as k
  from (
    select *, cast(case when mean <= 32 then list_reduce(
             list_transform(range(0, least(drawn, 127, cast(ceil(mean + 8 * sqrt(mean) + 10) as bigint)) + 1),
                            lambda i: {{'here': 0.0e0, 'below': 0.0e0, 'k': 0.0e0, 'i': cast(i as double)}}),
             lambda s, x: {{'here': s.here * (drawn - x.i) / (x.i + 1) * (p / (1 - p)), 'below': s.below + s.here,
                            'k': s.k + case when s.below + s.here < u then 1.0e0 else 0.0e0 end, 'i': x.i}},
             {{'here': exp(drawn * ln(1 - p)), 'below': 0.0e0, 'k': 0.0e0, 'i': 0.0e0}}).k
           else greatest(0.0e0, floor(mean + sqrt(mean * (1 - p)) * sqrt(-2 * ln(u)) * cos(2 * pi() * w) + 0.5e0)) end as bigint) as rare
    from (
      select *, drawn * p as mean, {_UNIFORM.format(at=1)} as u, {_UNIFORM.format(at=13)} as w
      from (
        select d.*, t.first, t.whole, cast(least(t.first, t.whole - t.first) as double) / t.whole as p,
               md5(concat_ws('|', '0', d.model_name, d.strategy, d.replicate, d.level, d.node)) as h
        from draws d join tree t on d.model_name = t.model_name and d.strategy = t.strategy and d.level = t.level and d.node = t.node
      ) a) b) c) e, (values (0), (1)) sides(side)
where case when side = 0 then k else drawn - k end > 0
"""
STEPS["resampled"] = """
select model_name, strategy, round(quantile_cont(mean, 0.025), 9) as lo, round(quantile_cont(mean, 0.975), 9) as hi, count(*) as replicates
from (select d.model_name, d.strategy, replicate, sum(drawn * v) / max(cells) as mean
      from draws d join variances v on d.model_name = v.model_name and d.strategy = v.strategy and d.node = v.place
      where level = (select coalesce(max(level) + 1, 0) from tree) group by all) m
group by model_name, strategy
"""


def recursive(body: str) -> str:
    return sql(body).replace("with ", "with recursive ", 1)


QUERIES["stability_summary"] = (
    summary,
    recursive(f"""
with totals as (select model_name, strategy, {RATES}, cast(sum(latencies) as bigint) as timed_runs
     from cells group by model_name, strategy),
     pct as ({LATENCY_SQL})
select t.*, {CI_SQL}, r.lo as average_variance_lo, r.hi as average_variance_hi,
       coalesce(p50_latency_ms, 0.0) as p50_latency_ms, coalesce(p90_latency_ms, 0.0) as p90_latency_ms
from totals t left join pct on t.model_name = pct.model_name and t.strategy = pct.strategy
left join resampled r on t.model_name = r.model_name and t.strategy = r.strategy"""),
)

QUERIES["stability_cells"] = (
    cells,
    sql("select * from cells"),
)

QUERIES["stability_grouping"] = (
    lambda spark, sf: rates(stability.grouped_stability(cells(spark, sf))),
    sql(f"""select model_name, case when grouping(strategy) = 1 then 'overall' else strategy end as strategy, {RATES}
from cells group by grouping sets ((model_name, strategy), (model_name))"""),
)

QUERIES["av_unbiased"] = (
    lambda spark, sf: stability.cell_totals(counts(spark, sf), BY, ks=()).select(
        *BY,
        F.round("average_variance", 9).alias("average_variance"),
        F.round("average_variance_unbiased", 9).alias("average_variance_unbiased"),
    ),
    sql("""select model_name, strategy, round(avg((a / n) * (1 - a / n)), 9) as average_variance,
       round(avg(case when n > 1 then (n / (n - 1.0e0)) * (a / n) * (1 - a / n) else 0.0 end), 9) as average_variance_unbiased
from cells group by model_name, strategy"""),
)

QUERIES["pass_at_k"] = (
    lambda spark, sf: stability.cell_totals(cells(spark, sf), BY, ks=(1, 2, 3, 5, 7)).select(
        *BY, "total_problems", *[f"pass_at_{k}" for k in (1, 2, 3, 5, 7)]
    ),
    sql("select model_name, strategy, count(*) as total_problems, "
        + ", ".join(
            f"cast(count(*) filter (where first_accepted between 1 and {k}) as double) * 100.0"
            f" / cast(count(*) as double) as pass_at_{k}" for k in (1, 2, 3, 5, 7))
        + " from cells group by model_name, strategy"),
)

QUERIES["pass_at_k_head"] = (
    lambda spark, sf: stability.pass_at_k_rows(
        trials(spark, sf), ["problem_id", "model_name", "strategy"], BY, 2
    ),
    sql("""select model_name, strategy, count(*) as problems, cast(sum(hit) as bigint) as passed,
       cast(sum(hit) as double) * 100.0 / cast(count(*) as double) as pass_at_k
from (select model_name, strategy, problem_id, max(accepted) as hit
      from (select *, row_number() over (partition by model_name, strategy, problem_id order by trial_index) as rn
            from trials) t where rn <= 2 group by model_name, strategy, problem_id) p
group by model_name, strategy"""),
)


def attempt_arrays(spark, sf, k):
    """The first k statuses of each cell in order, which is all that pass@k reads."""
    order = Window.partitionBy(*stability.CELL).orderBy("trial_index")
    first = trials(spark, sf).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    return first.groupBy(*stability.CELL).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("trial_index", "status"))), lambda t: t.status
        ).alias("statuses")
    )


QUERIES["pass_at_k_array"] = (
    lambda spark, sf: stability.pass_at_k_arrays(attempt_arrays(spark, sf, 3), "statuses", 3, ["model_name"]),
    sql("""select model_name, count(*) as problems, count(*) filter (where first_accepted between 1 and 3) as passed,
       cast(count(*) filter (where first_accepted between 1 and 3) as double) * 100.0 / cast(count(*) as double) as pass_at_k
from cells group by model_name"""),
)

QUERIES["wilson_ci"] = (
    lambda spark, sf: intervals(
        stability.with_intervals(stability.cell_totals(counts(spark, sf), BY, ks=())).select(
            *BY, *[f"{name}_ci_95" for name, _, _ in CI]
        )
    ),
    sql(f"""with totals as (select model_name, strategy, {RATES} from cells group by model_name, strategy)
select model_name, strategy, {CI_SQL} from totals"""),
)

QUERIES["av_bootstrap"] = (
    lambda spark, sf: inference.bootstrap_mean(
        counts(spark, sf).withColumn("variance", F.col("a") / F.col("n") * (1 - F.col("a") / F.col("n"))),
        BY,
        "variance",
    ).withColumns({c: F.round(c, 9) for c in ("lo", "hi")}),
    recursive("select * from resampled"),
)

QUERIES["latency_percentiles"] = (
    lambda spark, sf: stability.latency_percentiles(trials(spark, sf), BY).select(
        *BY, *[F.round(c, 6).alias(c) for c in ("p50_latency_ms", "p90_latency_ms")]
    ),
    sql(LATENCY_SQL),
)

QUERIES["trial_dedupe"] = (
    lambda spark, sf: trials(spark, sf).select(*stability.TRIAL_KEY, "status", "submission_id"),
    sql("select model_name, problem_id, strategy, trial_index, status, submission_id from trials"),
)

QUERIES["attempt_ordinals"] = (
    lambda spark, sf: stability.attempt_ordinals(
        trial_log(spark, sf),
        stability.CELL,
        [F.col(c) for c in ("logged_at", *[f"tie_{i}" for i in range(1, 8)], "trial_index")],
    ).select(*stability.TRIAL_KEY, "submission_id", "tie_1", "ordinal"),
    sql("""select model_name, problem_id, strategy, trial_index, submission_id, tie_1,
       row_number() over (partition by model_name, problem_id, strategy
         order by logged_at, tie_1, tie_2, tie_3, tie_4, tie_5, tie_6, tie_7, trial_index) as ordinal
from log"""),
)

QUERIES["strategy_normalized"] = (
    lambda spark, sf: trial_log(spark, sf).groupBy("strategy", "prompt_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("accepted").alias("accepted")
    ),
    sql("""select strategy, prompt_type, count(*) as rows, cast(sum(accepted) as bigint) as accepted
from log group by strategy, prompt_type"""),
)

QUERIES["mcnemar"] = (
    # Exact p are fractions of a power of two, many of them halfway between two values of six decimals.
    lambda spark, sf: inference.mcnemar(counts(spark, sf), ["model_name"]).withColumn("p", F.round(F.round("p", 12), 6)),
    sql("""select model_name, pairs, b_only, c_only,
       round(case when b_only = c_only then 1.0 else least(1.0, 2.0 * list_sum(list_transform(range(0, least(b_only, c_only) + 1),
         lambda k: exp(lgamma(b_only + c_only + 1) - lgamma(k + 1) - lgamma(b_only + c_only - k + 1)
                  - (b_only + c_only) * ln(2.0))))) end, 6) as p
from (select d.model_name, count(*) as pairs,
             count(*) filter (where d.a = d.n and m.a <> m.n) as b_only,
             count(*) filter (where d.a <> d.n and m.a = m.n) as c_only
      from cells d join cells m on d.model_name = m.model_name and d.problem_id = m.problem_id
      where d.strategy = 'detailed' and m.strategy = 'minimal' group by d.model_name) t"""),
)


def with_sql_functions(spark, sf):
    """The three SQL functions over the raw log."""
    sql_functions.register(spark)
    return spark.sql(
        """select model_name, strategy, runs, round(ci.lo, 6) as lo, round(ci.hi, 6) as hi, id from (
  select model_name, strategy, count(*) as runs,
         wilson(count_if(status = 'Accepted'), count(*)) as ci,
         custom_id(model_name, 'all of them', 's/1', strategy, count(*)) as id
  from (select model_name, status, normalize_strategy(strategy, prompt_type) as strategy from {log}) l
  group by model_name, strategy) t""",
        log=view(spark, sf, "v_trial_log"),
    )


QUERIES["sql_functions"] = (
    with_sql_functions,
    sql(f"""select model_name, strategy, runs, {wilson_sql("hits", "runs", "lo")} as lo, {wilson_sql("hits", "runs", "hi")} as hi,
       concat('model=', model_name, '|problem=all_of_them|slug=s_1|prompt=', strategy, '|trial=', cast(runs as varchar)) as id
from (select model_name, strategy, count(*) as runs, cast(sum(accepted) as bigint) as hits from log group by model_name, strategy) t"""),
)
