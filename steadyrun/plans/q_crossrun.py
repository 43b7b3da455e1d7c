"""Summaries over runs and the comparisons of prompts and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyrun.functions import render
from steadyrun.operators import crossrun, inference, problems as prob, stability
from steadyrun.plans.common import STEPS, configs, counts, sql, trials
from steadyrun.plans.q_report import problems, rounded
from steadyrun.plans.q_stability import CI_SQL, LATENCY_SQL, RATES, recursive, summary_rows
from steadyrun.sources import json_arrays, readers
from steadyrun.sources.scratch import shared_dir, stored
from steadyrun.sources.tables import table, view

QUERIES = {}

STEPS["loaded"] = """
select * exclude (generation_mode), coalesce(generation_mode, 'realtime') as generation_mode
from v_summaries where prompt_type in ('detailed', 'minimal')
"""
STEPS["latest"] = """
select * exclude (rn) from (
  select *, row_number() over (
    partition by model_name, prompt_type, dataset, num_problems, stability_runs, generation_mode,
                 temperature, top_p, max_tokens
    order by case when regexp_matches(experiment_name, '^[0-9]{8}_[0-9]{6}') then substr(experiment_name, 1, 15)
                  else coalesce(experiment_name, '') end desc, seq) as rn
  from loaded) t where rn = 1
"""
STEPS["eligible"] = """
select * from latest where dataset = 'main' and num_problems >= 10 and stability_runs >= 3
  and generation_mode in ('realtime', 'qwen_batch', 'openai_batch', 'anthropic_batch', 'gemini_batch', 'azure_batch', 'bedrock_batch')
"""
STEPS["paper_models"] = """
select model_name, max(run_level_pass_rate) as best_rlpr from eligible where prompt_type = 'detailed' group by model_name
"""
STEPS["totals"] = f"""
select model_name, strategy as prompt_type, {RATES} from cells group by model_name, strategy
"""


def loaded(spark, sf):
    return crossrun.load_summaries(view(spark, sf, "v_summaries"))


def latest(spark, sf):
    return crossrun.dedupe_summaries(loaded(spark, sf))


def totals(spark, sf):
    """One summary row per model and prompt with intervals."""
    rows = stability.with_intervals(
        stability.cell_totals(counts(spark, sf), ["model_name", "strategy"], ks=())
    )
    return rows.withColumnRenamed("strategy", "prompt_type")


KEPT = [
    "experiment_name", "model_name", "prompt_type", "dataset", "num_problems", "stability_runs",
    "generation_mode", "run_level_pass_rate",
]

# A file of so many summaries is sorted and read in memory, so the number of files grows with the table.
ROWS_PER_FILE = 200_000


def summaries_read(spark, sf):
    """The summaries written as compressed files of JSON arrays and read back."""
    path = shared_dir(spark, "summaries")
    rows = view(spark, sf, "v_summaries")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_FILE))
    # Intervals are two numbers in a file.
    pair = F.array(F.col("run_level_pass_rate") - 1, F.col("run_level_pass_rate") + 1)
    json_arrays.write_array(rows.withColumn("run_level_ci_95", pair), path, [F.col("seq")], files, compression="lz4")
    return crossrun.load_summaries(readers.read_summaries(spark, path, "*.txt.lz4"))


QUERIES["summary_load"] = (
    lambda spark, sf: rounded(
        summaries_read(spark, sf).select(*KEPT, F.col("run_level_ci_95.lo").alias("lo"), F.col("run_level_ci_95.hi").alias("hi")), "lo", "hi"
    ),
    sql(f"""select {', '.join(KEPT)}, round(run_level_pass_rate - 1, 6) as lo, round(run_level_pass_rate + 1, 6) as hi from loaded"""),
)
QUERIES["summary_dedupe"] = (
    lambda spark, sf: latest(spark, sf).select(*KEPT, "temperature", "top_p", "max_tokens"),
    sql(f"select {', '.join(KEPT)}, temperature, top_p, max_tokens from latest"),
)
QUERIES["paper_summaries"] = (
    lambda spark, sf: crossrun.paper_eligible(latest(spark, sf)).select(*KEPT),
    sql(f"select {', '.join(KEPT)} from eligible"),
)
QUERIES["accuracy_stability"] = (
    lambda spark, sf: crossrun.accuracy_stability(latest(spark, sf)),
    sql("""select l.experiment_name, l.model_name, l.prompt_type, l.run_level_pass_rate, l.perfect_stability_rate,
       e.seq is not null as paper_eligible from latest l left join eligible e on l.seq = e.seq"""),
)

def board(spark, sf):
    rows = summary_rows(spark, sf).withColumnRenamed("strategy", "prompt_type")
    return crossrun.leaderboard(stored(crossrun.with_settings(rows, view(spark, sf, "v_summaries")), "summaries"))


def _text(value: str, decimals: int) -> str:
    fixed = f"printf('%.{decimals}f', {value})"
    return rf"regexp_replace({fixed}, '(\.[0-9]+?)0+$', '\1')"


def _ci(name: str) -> str:
    lo, hi = (f"rint_2({name}_{s})" for s in ("lo", "hi"))
    out = f"concat('[', {_text(lo, 2)}, ', ', {_text(hi, 2)}, ']')"
    return out.replace("rint_2(", "round_even(").replace("_lo)", "_lo, 2)").replace("_hi)", "_hi, 2)")


STEPS["settings"] = """
select * from (select *, row_number() over (partition by model_name, prompt_type
    order by case when regexp_matches(experiment_name, '^[0-9]{8}_[0-9]{6}') then substr(experiment_name, 1, 15)
                  else coalesce(experiment_name, '') end desc, seq) as rn from loaded) t where rn = 1
"""
STEPS["board"] = f"""
select row_number() over (order by "Run-Level Pass Rate" desc, "Model", "Prompt") as row_no, * from (
  select t.model_name as "Model", t.prompt_type as "Prompt", s.dataset as "Dataset", s.num_problems as "Num Problems",
         s.stability_runs as "Stability Runs", s.generation_mode as "Generation Mode",
         round_even(t.run_level_pass_rate, 2) as "Run-Level Pass Rate",
         round_even(t.first_pass_accuracy, 2) as "First-Pass Accuracy",
         round_even(t.perfect_stability_rate, 2) as "Perfect Stability Rate",
         round_even(t.average_variance, 4) as "Average Variance",
         {_ci("run_level")} as "RLPR 95% CI", {_ci("first_pass")} as "FPA 95% CI",
         {_ci("perfect_stability")} as "PSR 95% CI",
         concat('[', {_text("round_even(r.lo, 4)", 4)}, ', ', {_text("round_even(r.hi, 4)", 4)}, ']') as "AV 95% CI",
         round_even(coalesce(p.p90_latency_ms, 0.0), 2) as "p90 Latency"
  from (select *, {CI_SQL} from totals) t
  left join settings s on t.model_name = s.model_name and t.prompt_type = s.prompt_type
  left join resampled r on t.model_name = r.model_name and t.prompt_type = r.strategy
  left join ({LATENCY_SQL}) p on t.model_name = p.model_name and t.prompt_type = p.strategy) b
"""
QUERIES["leaderboard"] = (board, recursive("select * from board"))

_NAMES = list(crossrun.LEADERBOARD.values())
_DIGITS = {t: crossrun.SUMMARY_DECIMALS[c] for c, t in crossrun.LEADERBOARD.items() if c in crossrun.SUMMARY_DECIMALS}
_COLS = [
    _text(f'"{n}"', _DIGITS[n]) if n in _DIGITS else f"""coalesce(cast("{n}" as varchar), 'None')""" for n in _NAMES
]

QUERIES["leaderboard_md"] = (
    lambda spark, sf: crossrun.leaderboard_markdown(board(spark, sf)),
    recursive(f"""select cast(row_no as bigint) as line_no, concat('| ', concat_ws(' | ', {', '.join(_COLS)}), ' |') as line from board
union all select -1, '| {' | '.join(_NAMES)} |' union all select 0, '| {' | '.join('---' for _ in _NAMES)} |'"""),
)


def _tex(col: str) -> str:
    for old, new in render.LATEX_ESCAPES:
        col = f"replace({col}, '{old}', '{new}')"
    return col


QUERIES["leaderboard_tex"] = (
    lambda spark, sf: crossrun.leaderboard_latex(board(spark, sf)),
    recursive(f"""select cast(row_no as bigint) as line_no, concat(concat_ws(' & ', {', '.join(_tex(c) for c in _COLS)}), ' \\\\') as line from board
union all select * from (values (-3, '\\begin{{tabular}}{{{'l' * len(_NAMES)}}}'), (-2, '\\hline'),
  (-1, '{" & ".join(n.replace("%", chr(92) + "%") for n in _NAMES)} \\\\'), (0, '\\hline')) as h(line_no, line)
union all select count(*) + 1, '\\hline' from board union all select count(*) + 2, '\\end{{tabular}}' from board"""),
)

QUERIES["interval_texts"] = (
    lambda spark, sf: totals(spark, sf).select(
        "model_name", "prompt_type",
        *[render.interval_text(F.col(f"{c}_ci_95.lo"), F.col(f"{c}_ci_95.hi"), 2, "%").alias(c) for c in ("run_level", "perfect_stability")],
    ),
    sql(f"""select model_name, prompt_type, printf('[%.2f%%, %.2f%%]', run_level_lo, run_level_hi) as run_level,
       printf('[%.2f%%, %.2f%%]', perfect_stability_lo, perfect_stability_hi) as perfect_stability
from (select *, {CI_SQL} from totals) t"""),
)

QUERIES["display_names"] = (
    lambda spark, sf: view(spark, sf, "v_manifest").groupBy("model_id").agg(
        F.count(F.lit(1)).alias("requests")
    ).withColumn("display_name", render.display_name(F.col("model_id"))),
    sql("""select model_id, count(*) as requests, case model_id when 'qwen-plus' then 'Qwen-Plus' else model_id end as display_name
from v_manifest group by model_id"""),
)

QUERIES["gap"] = (
    lambda spark, sf: rounded(
        crossrun.gaps(configs(spark, sf)).select("model_name", "prompt_type", "gap", "is_largest", "is_smallest"),
        "gap",
    ),
    sql("""select model_name, prompt_type, round(rlpr - psr, 6) as gap, rlpr - psr = max(rlpr - psr) over () as is_largest,
       rlpr - psr = min(rlpr - psr) over () as is_smallest from configs"""),
)
STEPS["means"] = """
select model_name, avg(rlpr) as rlpr, avg(psr) as psr, avg(rlpr - psr) as gap, avg(av) as av,
       bool_or(is_reasoning) as is_reasoning from configs group by model_name
"""
QUERIES["model_means"] = (
    lambda spark, sf: rounded(crossrun.model_means(configs(spark, sf)), "rlpr", "psr", "gap", "av"),
    sql("""select model_name, round(rlpr, 6) as rlpr, round(psr, 6) as psr, round(gap, 6) as gap, round(av, 6) as av,
       is_reasoning from means"""),
)
QUERIES["av_by_type"] = (
    lambda spark, sf: rounded(crossrun.av_by_type(configs(spark, sf)), "mean_av"),
    sql("select is_reasoning, round(avg(av), 6) as mean_av, count(*) as models from means group by is_reasoning"),
)


def with_gap(spark, sf):
    return configs(spark, sf).withColumn("gap", F.col("rlpr") - F.col("psr"))


FIT = """select regr_slope(rlpr - psr, rlpr) as slope, regr_intercept(rlpr - psr, rlpr) as intercept,
       corr(rlpr - psr, rlpr) as r, regr_r2(rlpr - psr, rlpr) as r2, count(*) as n,
       sqrt(greatest(0.0, regr_syy(rlpr - psr, rlpr) * (1 - regr_r2(rlpr - psr, rlpr))) / ((count(*) - 2) * regr_sxx(rlpr - psr, rlpr))) as std_err
from configs"""


def _tail(t: str, v: str) -> str:
    """Two-sided tail of Student's t by Simpson's rule over the next 60 units."""
    density = (
        f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0) - 0.5 * ln({v} * pi())"
        f" - ({v} + 1) / 2.0 * ln(1 + power(abs({t}) + i * 0.005, 2) / {v}))"
    )
    weight = "(case when i = 0 or i = 12000 then 1 when i % 2 = 1 then 4 else 2 end)"
    return f"2.0 * 0.005 / 3.0 * list_sum(list_transform(range(0, 12001), lambda i: {weight} * {density}))"


QUERIES["gap_regression"] = (
    lambda spark, sf: rounded(
        inference.linear_fit(with_gap(spark, sf), "rlpr", "gap"), "slope", "intercept", "r", "r2", "std_err", "p"
    ),
    sql(f"""with fit as ({FIT})
select round(slope, 6) as slope, round(intercept, 6) as intercept, round(r, 6) as r, round(r2, 6) as r2, n,
       round(std_err, 6) as std_err, round({_tail("(slope / std_err)", "(n - 2)")}, 6) as p from fit"""),
)
STEPS["resid"] = """
select c.model_name, c.prompt_type, c.is_reasoning, (c.rlpr - c.psr) - (f.intercept + f.slope * c.rlpr) as residual
from configs c, (select regr_slope(rlpr - psr, rlpr) as slope, regr_intercept(rlpr - psr, rlpr) as intercept from configs) f
"""


def residual_rows(spark, sf):
    return inference.residuals(with_gap(spark, sf), "rlpr", "gap")


QUERIES["gap_residuals"] = (
    lambda spark, sf: residual_rows(spark, sf).groupBy("is_reasoning").agg(
        F.count(F.lit(1)).alias("configs"), F.round(F.avg("residual"), 6).alias("mean_residual")
    ),
    sql("""select is_reasoning, count(*) as configs, round(avg(residual), 6) as mean_residual
from resid group by is_reasoning"""),
)
QUERIES["permutation_test"] = (
    lambda spark, sf: rounded(
        inference.permutation_test(residual_rows(spark, sf), ["model_name", "prompt_type"], "is_reasoning", "residual"),
        "observed",
    ),
    sql("""with d as (select concat_ws('|', model_name, prompt_type) as id, is_reasoning as flag,
             cast(round(residual * 1e9) as bigint) as v from resid),
s as (select count(*) filter (where flag) as k, count(*) as n, cast(sum(v) as bigint) as total,
             cast(sum(v) filter (where flag) as bigint) as flagged from d),
reps as (select rep, cast(sum(v) filter (where rn <= k) as bigint) as f from (
   select r.rep, d.v, s.k, row_number() over (partition by r.rep order by md5(concat_ws('|', cast(r.rep as varchar), d.id)), d.id) as rn
   from d, range(0, 10000) as r(rep), s) t group by rep)
select count(*) as permutations,
       count(*) filter (where abs(f * (n - k) - (total - f) * k) >= abs(flagged * (n - k) - (total - flagged) * k)) as extreme,
       cast(count(*) filter (where abs(f * (n - k) - (total - f) * k) >= abs(flagged * (n - k) - (total - flagged) * k)) as double)
         / count(*) as p,
       round(any_value(flagged / k / 1e9 - (total - flagged) / (n - k) / 1e9), 6) as observed
from reps, s"""),
)
QUERIES["rlpr_psr_corr"] = (
    lambda spark, sf: configs(spark, sf).agg(
        F.round(F.corr("rlpr", "psr"), 6).alias("correlation"), F.count(F.lit(1)).alias("configs")
    ),
    sql("select round(corr(rlpr, psr), 6) as correlation, count(*) as configs from configs"),
)
QUERIES["prompt_winners"] = (
    lambda spark, sf: rounded(crossrun.prompt_winners(configs(spark, sf)), "mean_abs_difference"),
    sql("""select count(*) filter (where d.psr > m.psr) as detailed_wins, count(*) filter (where m.psr > d.psr) as minimal_wins,
       count(*) filter (where d.psr = m.psr) as ties, round(avg(abs(d.psr - m.psr)), 6) as mean_abs_difference
from configs d join configs m on d.model_name = m.model_name and d.prompt_type = 'detailed' and m.prompt_type = 'minimal'"""),
)
QUERIES["prompt_pairs"] = (
    lambda spark, sf: crossrun.prompt_pairs(configs(spark, sf)),
    sql("""select coalesce(d.model_name, m.model_name) as model_name,
       d.rlpr as detailed_rlpr, d.psr as detailed_psr, d.av as detailed_av,
       m.rlpr as minimal_rlpr, m.psr as minimal_psr, m.av as minimal_av
from (select * from configs where prompt_type = 'detailed') d
full join (select * from configs where prompt_type = 'minimal') m on d.model_name = m.model_name"""),
)
QUERIES["rank_reversals"] = (
    lambda spark, sf: rounded(
        crossrun.rank_reversals(stored(configs(spark, sf), "configs")), "rlpr", "psr", "rival_rlpr", "rival_psr"
    ),
    sql("""select prompt_type, model_name, round(rlpr, 6) as rlpr, round(psr, 6) as psr, rival,
       round(rival_rlpr, 6) as rival_rlpr, round(rival_psr, 6) as rival_psr, reversals
from (select a.prompt_type, a.model_name, a.rlpr, a.psr, b.model_name as rival, b.rlpr as rival_rlpr, b.psr as rival_psr,
             count(*) filter (where b.psr > a.psr) over (partition by a.prompt_type, a.model_name) as reversals,
             row_number() over (partition by a.prompt_type, a.model_name order by b.psr desc, b.model_name desc) as rn
      from configs a join configs b on a.prompt_type = b.prompt_type and a.rlpr > b.rlpr) t
where rn = 1 and rival_psr > psr"""),
)
QUERIES["model_rank"] = (
    lambda spark, sf: crossrun.model_rank(stored(configs(spark, sf), "configs")),
    sql("""select prompt_type, model_name, cast(rank() over (partition by prompt_type order by rlpr desc) as int) as rlpr_rank,
       cast(dense_rank() over (partition by prompt_type order by rlpr desc) as int) as rlpr_dense_rank,
       cast(rank() over (partition by prompt_type order by psr desc) as int) as psr_rank from configs"""),
)

QUERIES["trial_difficulty"] = (
    lambda spark, sf: prob.with_difficulty(trials(spark, sf), problems(spark, sf)).select(
        *stability.TRIAL_KEY, "difficulty", "accepted"
    ),
    sql("""select t.model_name, t.problem_id, t.strategy, t.trial_index, coalesce(p.difficulty, 'Unknown') as difficulty, t.accepted
from trials t left join problems p on t.problem_id = p.problem_id"""),
)


def models(spark, sf):
    return crossrun.paper_models(view(spark, sf, "v_summaries"))


QUERIES["ranked_model_trials"] = (
    lambda spark, sf: crossrun.ranked_model_trials(trials(spark, sf), models(spark, sf)).select(
        *stability.TRIAL_KEY, "accepted"
    ),
    sql("""select model_name, problem_id, strategy, trial_index, accepted from trials
where model_name in (select model_name from paper_models)"""),
)

STEPS["rates"] = """
select model_name, problem_id, cast(sum(accepted) as double) / count(*) as rate from trials
where strategy = 'detailed' and model_name in (select model_name from paper_models) group by model_name, problem_id
"""
STEPS["heat_cols"] = """
select *, row_number() over (order by tier, mean_rate desc, substr(md5(problem_id), 1, 3), problem_id) as col_pos from (
  select r.problem_id, r.mean_rate, case p.difficulty when 'Easy' then 0 when 'Medium' then 1 when 'Hard' then 2 else 3 end as tier
  from (select problem_id, round(sum(rate) / (select count(distinct model_name) from rates), 9) as mean_rate
        from rates group by problem_id) r left join problems p on r.problem_id = p.problem_id) t
"""
STEPS["heat_rows"] = """
select model_name, row_number() over (order by best_rlpr desc, model_name) as row_pos from paper_models
where model_name in (select model_name from rates)
"""


def heatmap(spark, sf):
    rows = crossrun.stability_heatmap(trials(spark, sf), problems(spark, sf), models(spark, sf))
    return rows.withColumn("mean_rate", F.round("mean_rate", 9))


QUERIES["stability_heatmap"] = (
    heatmap,
    sql("""select r.model_name, r.problem_id, r.rate, h.row_pos, c.tier, c.mean_rate, c.col_pos
from rates r join heat_rows h on r.model_name = h.model_name join heat_cols c on r.problem_id = c.problem_id"""),
)
QUERIES["tier_boundaries"] = (
    lambda spark, sf: crossrun.tier_boundaries(
        prob.with_difficulty(trials(spark, sf).select("problem_id").distinct(), problems(spark, sf)).select(
            "problem_id", prob.tier_order(F.col("difficulty")).alias("tier")
        )
    ),
    sql("""select tier, count(*) as size, min(pos) - 1 as boundary from (
  select tier, row_number() over (order by tier, problem_id) as pos from (
    select t.problem_id, case p.difficulty when 'Easy' then 0 when 'Medium' then 1 when 'Hard' then 2 else 3 end as tier
    from (select distinct problem_id from trials) t left join problems p on t.problem_id = p.problem_id) x) y
group by tier having min(pos) > 1"""),
)
BUCKETS = "(values ('0/5', 0), ('1/5', 1), ('2/5', 2), ('3/5', 3), ('4/5', 4), ('5/5', 5)) as k(bucket, b)"
_BUCKET = """case when rate <= 0.01 then 0 when rate <= 0.21 then 1 when rate <= 0.41 then 2 when rate <= 0.61 then 3
  when rate <= 0.81 then 4 else 5 end"""
QUERIES["success_buckets"] = (
    lambda spark, sf: crossrun.success_buckets(
        crossrun.ranked_model_trials(trials(spark, sf), models(spark, sf))
    ),
    sql(f"""select k.bucket, count(r.problem_id) as problems from {BUCKETS}
left join (select problem_id, {_BUCKET} as b from (
     select problem_id, round(avg(accepted), 4) as rate from trials
     where strategy = 'detailed' and model_name in (select model_name from paper_models) group by problem_id) t) r on r.b = k.b
group by k.bucket"""),
)
QUERIES["success_buckets_by_model"] = (
    lambda spark, sf: crossrun.success_buckets(trials(spark, sf), by_model=True),
    sql(f"""select m.model_name, k.bucket, count(r.problem_id) as problems
from {BUCKETS} join (select distinct model_name from trials where strategy = 'detailed') m on true
left join (select model_name, problem_id, {_BUCKET} as b from (
     select model_name, problem_id, round(avg(accepted), 4) as rate from trials
     where strategy = 'detailed' group by model_name, problem_id) t) r on r.b = k.b and r.model_name = m.model_name
group by m.model_name, k.bucket"""),
)


def _bar(metric: str, ci: str) -> str:
    return f"""select model_name, prompt_type, '{metric}' as metric, {metric} as value,
       round(greatest(0.0, {metric} - {ci}_lo), 5) as lower_err, round(greatest(0.0, {ci}_hi - {metric}), 5) as upper_err from ci"""


QUERIES["prompt_bars"] = (
    lambda spark, sf: crossrun.prompt_bars(stored(totals(spark, sf), "summaries")).withColumns(
        {c: F.round(c, 5) for c in ("lower_err", "upper_err")}
    ),
    sql(f"""with ci as (select *, {CI_SQL.replace("* 100.0, 6)", "* 100.0, 12)")} from totals),
pos as (select model_name, row_number() over (order by max(run_level_pass_rate) desc, model_name) as model_pos from totals group by model_name)
select b.*, pos.model_pos from ({_bar("run_level_pass_rate", "run_level")} union all {_bar("perfect_stability_rate", "perfect_stability")}) b
join pos on b.model_name = pos.model_name"""),
)

STEPS["retry"] = """
select model_name, problem_id, bool_or(submission_id is null and status = 'Submission Failed') as needs_retry
from trials group by model_name, problem_id
"""
QUERIES["retry_problems"] = (
    lambda spark, sf: crossrun.retry_problems(trials(spark, sf)),
    sql("select * from retry"),
)
QUERIES["coverage"] = (
    lambda spark, sf: crossrun.coverage(trials(spark, sf)),
    sql("select model_name, count(*) filter (where not needs_retry) as covered, count(*) as total from retry group by model_name"),
)


def pending(spark, sf):
    """What the detailed run of every model still has to submit, given all earlier results."""
    t = trials(spark, sf)
    items = t.where("strategy = 'detailed'").select("model_name", "problem_id").distinct()
    return crossrun.resume_pending(items, crossrun.retry_problems(t), ["model_name", "problem_id"])


QUERIES["resume_pending"] = (
    pending,
    sql("""select distinct model_name, problem_id from trials t where strategy = 'detailed' and not exists (
  select 1 from retry r where r.model_name = t.model_name and r.problem_id = t.problem_id and not r.needs_retry)"""),
)
QUERIES["report_config"] = (
    lambda spark, sf: crossrun.report_config(
        totals(spark, sf).select("model_name", "prompt_type", "total_runs", "run_level_pass_rate"),
        loaded(spark, sf),
    ),
    sql("""select t.model_name, t.prompt_type, t.total_runs, t.run_level_pass_rate, e.experiment_name, e.dataset, e.generation_mode,
       e.temperature, e.top_p, e.max_tokens
from totals t left join (select *, row_number() over (partition by model_name, prompt_type
       order by substr(experiment_name, 1, 15) desc, seq) as rn from loaded) e
  on e.rn = 1 and e.model_name = t.model_name and e.prompt_type = t.prompt_type"""),
)

EVALUATION = """case when event_type = 'purchase' and value > 20 then 'completed'
       when event_type = 'purchase' then 'submission_in_progress' else 'generation_in_progress' end"""
STEPS["evals"] = f"""
select concat('model-', cast(user_id % 16 as varchar)) as model_id, event_id, ts, {EVALUATION} as evaluation_state from events
"""


def readiness(spark, sf):
    events = table(spark, sf, "events")
    evaluations = events.selectExpr(
        "concat('model-', cast(user_id % 16 as string)) as model_id", "event_id", "ts",
        f"{EVALUATION} as evaluation_state",
    )
    return crossrun.model_readiness(view(spark, sf, "v_job_state"), evaluations)


STEPS["ready"] = """
with jobs as (select model_id, prompt_type, status = 'completed' and normalized_exists as ready from (
    select *, row_number() over (partition by model_id, prompt_type order by ts desc, event_id desc) as rn from v_job_state) t where rn = 1),
ev as (select model_id, evaluation_state from (
    select *, row_number() over (partition by model_id order by ts desc, event_id desc) as rn from evals) t where rn = 1),
s as (select model_id, coalesce(bool_or(prompt_type = 'detailed' and ready), false) as d,
             coalesce(bool_or(prompt_type = 'minimal' and ready), false) as m from jobs group by model_id)
select s.model_id, d as detailed_ready, m as minimal_ready, evaluation_state,
       case when evaluation_state = 'completed' then 'EVALUATION_COMPLETED' when d and m then 'READY_FOR_SUBMISSION'
            when d then 'WAITING_FOR_MINIMAL' when m then 'WAITING_FOR_DETAILED' else 'WAITING_FOR_BOTH' end as ready_state
from s left join ev on s.model_id = ev.model_id
"""
QUERIES["model_readiness"] = (readiness, sql("select * from ready"))
QUERIES["readiness_counts"] = (
    lambda spark, sf: crossrun.readiness_counts(readiness(spark, sf)),
    sql("""select count(*) filter (where ready_state = 'READY_FOR_SUBMISSION') as ready_models,
       count(*) filter (where ready_state = 'EVALUATION_COMPLETED') as completed_models,
       count(*) filter (where ready_state not in ('READY_FOR_SUBMISSION', 'EVALUATION_COMPLETED')) as pending_models from ready"""),
)
QUERIES["experiment_outcomes"] = (
    lambda spark, sf: crossrun.experiment_outcomes(
        view(spark, sf, "v_summaries").select((F.col("prompt_type") != "standard").alias("success"))
    ),
    sql("""select count(*) filter (where prompt_type <> 'standard') as successful,
       count(*) filter (where prompt_type = 'standard') as failed from v_summaries"""),
)
QUERIES["failure_runs"] = (
    lambda spark, sf: crossrun.failure_runs(view(spark, sf, "v_submissions"), threshold=5),
    sql("""with c as (select *, sum(case when submission_id is not null then 1 else 0 end)
       over (partition by account order by ts, event_id rows unbounded preceding) as successes_before
     from v_submissions where has_code)
select account, cast(successes_before as bigint) as successes_before, count(*) as run_length,
       arg_min(event_id, (ts, event_id)) as first_event, arg_max(event_id, (ts, event_id)) as last_event,
       count(*) >= 5 as breached
from c where submission_id is null group by account, successes_before"""),
)
