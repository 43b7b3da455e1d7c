"""Breakdowns of judged attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyrun.operators import inference, problems as prob, report, stability
from steadyrun.plans.common import STEPS, counts, sql, trials
from steadyrun.sources.tables import view

QUERIES = {}

STEPS["problems"] = """
select frontend_question_id as problem_id, title, topics, paid_only, seq,
       concat(upper(substr(trim(difficulty), 1, 1)), lower(substr(trim(difficulty), 2))) as difficulty
from v_problems
"""


def problems(spark, sf):
    return view(spark, sf, "v_problems")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


RATE = "cast(sum(accepted) as double) * 100.0 / cast(count(*) as double)"
COUNTS = f"count(*) as total, cast(sum(accepted) as bigint) as accepted, {RATE} as pass_rate"

QUERIES["pass_rate_by_prompt"] = (
    lambda spark, sf: report.pass_rate_by_prompt(trials(spark, sf), "model_name"),
    sql(f"select model_name, strategy, {COUNTS} from trials group by model_name, strategy"),
)


def _side(p: str, what: str) -> str:
    on = f"filter (where strategy = '{p}')"
    return {
        "total": f"count(status) {on}",
        "accepted": f"coalesce(cast(sum(accepted) {on} as bigint), 0)",
        "pass_rate": f"case when count(status) {on} = 0 then 0.0 else cast(sum(accepted) {on} as double) * 100.0"
        f" / cast(count(status) {on} as double) end",
    }[what]


QUERIES["pass_rate_by_difficulty"] = (
    lambda spark, sf: report.pass_rate_by_difficulty(trials(spark, sf), problems(spark, sf)),
    sql(f"""select k.difficulty,
       {", ".join(f"{_side(p, w)} as {p}_{w}" for p in report.PROMPTS for w in ("total", "accepted", "pass_rate"))},
       {_side("detailed", "pass_rate")} - {_side("minimal", "pass_rate")} as difference
from (values ('Easy'), ('Medium'), ('Hard')) as k(difficulty)
left join (select t.strategy, t.status, t.accepted, coalesce(p.difficulty, 'Unknown') as difficulty
           from trials t left join problems p on t.problem_id = p.problem_id) x on x.difficulty = k.difficulty
group by k.difficulty"""),
)

QUERIES["failure_counts"] = (
    lambda spark, sf: report.failure_counts(trials(spark, sf)),
    sql("""select strategy, status, count(*) as count, concat(strategy, '_', replace(lower(status), ' ', '_'), '_count') as key
from trials where status <> 'Accepted' group by strategy, status"""),
)

QUERIES["status_pivot"] = (
    lambda spark, sf: report.status_pivot(trials(spark, sf)),
    sql("""select status, count(*) filter (where strategy = 'detailed') as detailed,
       count(*) filter (where strategy = 'minimal') as minimal from trials group by status"""),
)

QUERIES["failure_share"] = (
    lambda spark, sf: report.failure_share(trials(spark, sf)),
    sql("""select status, count(*) as count,
       cast(count(*) as double) * 100.0 / cast(sum(count(*)) over () as double) as share
from trials where status <> 'Accepted' group by status"""),
)

QUERIES["generation_latency"] = (
    lambda spark, sf: rounded(
        report.generation_latency(trials(spark, sf), ["model_name", "strategy"]),
        "mean_latency_ms", "median_latency_ms", "p90_latency_ms",
    ),
    sql("""select model_name, strategy, round(avg(latency_ms), 6) as mean_latency_ms,
       round(quantile_cont(latency_ms, 0.5), 6) as median_latency_ms,
       round(quantile_cont(latency_ms, 0.9), 6) as p90_latency_ms from trials group by model_name, strategy"""),
)

QUERIES["generation_tokens"] = (
    lambda spark, sf: rounded(
        report.generation_tokens(trials(spark, sf), ["model_name", "strategy"]),
        "mean_input_tokens", "mean_output_tokens", "mean_total_tokens", "mean_cost",
    ),
    sql("""select model_name, strategy, round(avg(input_tokens), 6) as mean_input_tokens,
       round(avg(output_tokens), 6) as mean_output_tokens,
       round(avg(nullif(coalesce(input_tokens, 0) + coalesce(output_tokens, 0), 0)), 6) as mean_total_tokens,
       round(avg(cost), 6) as mean_cost from trials group by model_name, strategy"""),
)

QUERIES["judge_performance"] = (
    lambda spark, sf: rounded(
        report.judge_performance(trials(spark, sf)),
        "mean_runtime_percentile", "std_runtime_percentile", "top_25_runtime_pct", "median_runtime_percentile",
        "mean_memory_percentile", "std_memory_percentile", "median_memory_percentile",
    ),
    sql("""select strategy, round(avg(runtime_percentile), 6) as mean_runtime_percentile,
       round(stddev_samp(runtime_percentile), 6) as std_runtime_percentile,
       round(avg(case when runtime_percentile >= 75 then 1.0e0 when runtime_percentile < 75 then 0.0e0 end) * 100, 6) as top_25_runtime_pct,
       round(quantile_cont(runtime_percentile, 0.5), 6) as median_runtime_percentile,
       round(avg(memory_percentile), 6) as mean_memory_percentile,
       round(stddev_samp(memory_percentile), 6) as std_memory_percentile,
       round(quantile_cont(memory_percentile, 0.5), 6) as median_memory_percentile
from trials where accepted = 1 group by strategy"""),
)

QUERIES["prompt_effect"] = (
    lambda spark, sf: rounded(
        report.prompt_effect(trials(spark, sf), ["model_name"]),
        "pass_rate_difference", "pass_rate_improvement", "runtime_percentile_difference",
    ),
    sql("""with firsts as (select model_name, strategy, accepted from (
       select *, row_number() over (partition by model_name, problem_id, strategy order by trial_index) as rn
       from trials) t where rn = 1),
r as (select model_name,
       coalesce(cast(sum(accepted) filter (where strategy = 'detailed') as double) * 100.0
                / cast(count(*) filter (where strategy = 'detailed') as double), 0.0) as d,
       coalesce(cast(sum(accepted) filter (where strategy = 'minimal') as double) * 100.0
                / cast(count(*) filter (where strategy = 'minimal') as double), 0.0) as m
     from firsts group by model_name),
g as (select model_name, avg(runtime_percentile) filter (where strategy = 'detailed')
             - avg(runtime_percentile) filter (where strategy = 'minimal') as gap
     from trials where accepted = 1 group by model_name)
select r.model_name, d as detailed_pass_at_1, m as minimal_pass_at_1, round(d - m, 6) as pass_rate_difference,
       round(case when m > 0 then (d - m) / m * 100 when d > 0 then cast('infinity' as double) else 0.0 end, 6) as pass_rate_improvement,
       round(gap, 6) as runtime_percentile_difference
from r left join g on r.model_name = g.model_name"""),
)


def t_tail(t: str, v: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over the next 30 units."""
    density = (
        f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0) - 0.5 * ln({v} * pi())"
        f" - ({v} + 1) / 2.0 * ln(1 + power(abs({t}) + i * 0.005, 2) / {v}))"
    )
    weight = "(case when i = 0 or i = 6000 then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"2.0 * 0.005 / 3.0 * list_sum(list_transform(range(0, 6001), lambda i: {weight} * {density}))"


QUERIES["runtime_ttest"] = (
    lambda spark, sf: rounded(
        inference.pooled_t_test(
            trials(spark, sf).where("accepted = 1"), ["model_name"], "strategy", "detailed", "minimal",
            "runtime_percentile",
        ),
        "mean_difference", "t", "p",
    ),
    sql(f"""with g as (select model_name, strategy, count(runtime_percentile) as n, avg(runtime_percentile) as mean,
             var_samp(runtime_percentile) as var from trials where accepted = 1 group by model_name, strategy),
t as (select d.model_name, d.n as n_a, m.n as n_b, d.mean - m.mean as mean_difference, d.n + m.n - 2 as dof,
             (d.mean - m.mean) / sqrt(((d.n - 1) * d.var + (m.n - 1) * m.var) / (d.n + m.n - 2)
                                      * (1.0 / d.n + 1.0 / m.n)) as t
      from g d join g m on d.model_name = m.model_name where d.strategy = 'detailed' and m.strategy = 'minimal')
select model_name, n_a, n_b, round(mean_difference, 6) as mean_difference, round(t, 6) as t, dof,
       round({t_tail("t", "dof")}, 6) as p, {t_tail("t", "dof")} < 0.05 as significant from t"""),
)

TOPICS = """(select t.strategy, t.accepted, p.topics, trim(x.topic) as topic
      from trials t join problems p on t.problem_id = p.problem_id, unnest(string_split(p.topics, ',')) as x(topic))"""

QUERIES["topic_rates"] = (
    lambda spark, sf: report.topic_rates(trials(spark, sf), problems(spark, sf)),
    sql(f"select topic, strategy, {COUNTS} from {TOPICS} r group by topic, strategy"),
)

QUERIES["topic_heatmap"] = (
    lambda spark, sf: report.topic_heatmap(trials(spark, sf), problems(spark, sf)),
    sql(f"""select b.topic, r.strategy, {COUNTS}
from (select topic from {TOPICS} r group by topic order by count(*) desc, topic limit 10) b
join (select t.strategy, t.accepted, p.topics from trials t join problems p on t.problem_id = p.problem_id) r
  on contains(r.topics, b.topic)
group by b.topic, r.strategy"""),
)

QUERIES["dataset_stats"] = (
    lambda spark, sf: prob.dataset_stats(problems(spark, sf)),
    sql("""select 'problems' as kind, 'all' as label, count(*) as count from problems
union all select 'difficulty', difficulty, count(*) from problems group by difficulty
union all select * from (select 'topic', trim(x.topic) as label, count(*) as c from problems p, unnest(string_split(p.topics, ',')) as x(topic)
                         group by label order by c desc, label limit 15) t"""),
)


def histograms(spark, sf):
    t = trials(spark, sf)
    return report.percentile_histogram(t, "runtime_percentile").unionByName(
        report.percentile_histogram(t, "memory_percentile")
    )


def _histogram_sql(col: str) -> str:
    return f"""select b.strategy, '{col}' as metric, cast(k.bin as int) as bin, lo + width * k.bin as edge, coalesce(c.n, 0) as count
from (select strategy, lo, (hi - lo) / 20 as width from (
        select strategy, case when min({col}) = max({col}) then min({col}) - 0.5 else min({col}) end as lo,
               case when min({col}) = max({col}) then max({col}) + 0.5 else max({col}) end as hi
        from trials where accepted = 1 and {col} is not null group by strategy) z) b
join range(0, 20) as k(bin) on true
left join (select t.strategy, least(floor((t.{col} - z.lo) / ((z.hi - z.lo) / 20)), 19) as bin, count(*) as n
      from trials t join (select strategy, min({col}) as lo, max({col}) as hi from trials
                          where accepted = 1 and {col} is not null group by strategy) z on t.strategy = z.strategy
      where t.accepted = 1 and t.{col} is not null group by t.strategy, 2) c
  on c.strategy = b.strategy and c.bin = k.bin"""


QUERIES["percentile_histogram"] = (
    histograms,
    sql(f"{_histogram_sql('runtime_percentile')} union all {_histogram_sql('memory_percentile')}"),
)

QUERIES["runtime_memory_pairs"] = (
    lambda spark, sf: report.runtime_memory_pairs(trials(spark, sf)),
    sql("""select strategy, model_name, problem_id, trial_index, runtime_percentile, memory_percentile from trials
where accepted = 1 and runtime_percentile is not null and memory_percentile is not null"""),
)

QUERIES["trial_matrix"] = (
    lambda spark, sf: report.trial_matrix(trials(spark, sf), problems(spark, sf)),
    sql("""select t.model_name, t.problem_id, case when length(title) > 30 then concat(substr(title, 1, 30), '...') else title end as title,
       trial_index, accepted, max(trial_index) over (partition by t.model_name) + 1 as width
from trials t left join problems p on t.problem_id = p.problem_id where strategy = 'detailed'"""),
)

QUERIES["success_counts"] = (
    lambda spark, sf: report.success_counts(counts(spark, sf)),
    sql("""select g.model_name, g.successes, count(c.model_name) as problems
from (select model_name, unnest(range(0, max(n) + 1)) as successes from cells where strategy = 'detailed' group by model_name) g
left join cells c on c.model_name = g.model_name and c.a = g.successes and c.strategy = 'detailed'
group by g.model_name, g.successes"""),
)

QUERIES["prompt_metrics_long"] = (
    lambda spark, sf: report.prompt_metrics_long(
        stability.cell_totals(counts(spark, sf), ["model_name", "strategy"], ks=())
    ),
    sql("""select model_name, case strategy when 'detailed' then 'Detailed' else 'Minimal' end as prompt,
       'First-Pass Accuracy' as metric, cast(sum(first_pass) as double) * 100.0 / cast(count(*) as double) as value
from cells group by model_name, strategy
union all select model_name, case strategy when 'detailed' then 'Detailed' else 'Minimal' end, 'Perfect Stability Rate',
       cast(count(*) filter (where a = n) as double) * 100.0 / cast(count(*) as double)
from cells group by model_name, strategy"""),
)
