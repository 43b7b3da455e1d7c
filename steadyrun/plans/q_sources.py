"""Loading, choosing and writing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyrun.functions import labels
from steadyrun.operators import crossrun, problems as prob, stability
from steadyrun.plans.common import LOG_ORDER, sql, trial_log, trials
from steadyrun.plans.q_report import problems
from steadyrun.sources import json_arrays, readers, schemas, writers
from steadyrun.sources.scratch import shared_dir
from steadyrun.sources.tables import table, view

QUERIES = {}


def archive(spark, sf):
    """The log written as compressed JSON into a global and a run archive, read back from both, each attempt once."""
    log = view(spark, sf, "v_trial_log")
    shown = log.select(
        "model_name", "problem_id", "strategy", "prompt_type", "trial_index", "status", "latency_ms",
        F.col("submission_id").cast("string").alias("submission_id"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in LOG_ORDER]).alias("raw_response"),
    )
    dirs = [shared_dir(spark, name) for name in ("archive-global", "archive-run")]
    for path in dirs:
        shown.write.json(path, compression="lz4")
    read = readers.read_trial_archive(spark, [*dirs, dirs[0]], "*.json.*")
    return stability.dedupe_trials(read, [F.col("raw_response")]).select(
        *stability.TRIAL_KEY, "accepted"
    ).groupBy(*stability.CELL).agg(F.count(F.lit(1)).alias("n"))


QUERIES["trial_archive"] = (
    archive,
    sql("select model_name, problem_id, strategy, count(*) as n from trials group by model_name, problem_id, strategy"),
)


def nested_results(spark, sf):
    """Trials as nested results: one row per (model, problem) with an array of attempts per prompt.

    A cell has at most one trial per line number, so the arrays are short.
    """
    p = problems(spark, sf).select(
        F.col("frontend_question_id").alias("problem_id"), "title", "difficulty",
        labels.split_topics(F.col("topics")).alias("topics"),
    )
    attempt = F.struct(
        "trial_index", "status", F.col("latency_ms").cast("string").alias("latency_ms"),
        F.col("input_tokens").cast("string").alias("input_tokens"),
        F.coalesce(F.col("runtime_percentile").cast("string"), F.lit("n/a")).alias("runtime_percentile"),
        F.coalesce(F.col("memory_percentile").cast("string"), F.lit("n/a")).alias("memory_percentile"),
        F.col("submission_id").cast("string").alias("submission_id"),
    )

    def side(prompt):
        return F.array_sort(F.collect_list(F.when(F.col("strategy") == prompt, attempt)))

    rows = trials(spark, sf).groupBy("model_name", "problem_id").agg(
        side("detailed").alias("with_prompt"), side("minimal").alias("without_prompt")
    )
    return rows.join(p, "problem_id", "left")


def results_read(spark, sf):
    """The nested results written as compressed JSON arrays, a file a range of models and problems, and read back."""
    path = shared_dir(spark, "results")
    order = [F.col("model_name"), F.col("problem_id")]
    json_arrays.write_array(nested_results(spark, sf), path, order, compression="lz4")
    texts = json_arrays.elements(spark, [path])
    kind = f"model_name string, {schemas.RESULTS}"
    return texts.select(F.from_json("text", kind).alias("r")).select("r.*")


QUERIES["results_flat"] = (
    lambda spark, sf: readers.flatten_results(results_read(spark, sf)).select(
        "model_name", "problem_id", "title", "difficulty", "topics", "prompt_type", "strategy", "trial_index",
        "status", "latency_ms", "input_tokens", "runtime_percentile", "memory_percentile",
    ),
    sql("""select t.model_name, t.problem_id, p.title, p.difficulty, p.topics,
       case t.strategy when 'detailed' then 'with_prompt' else 'without_prompt' end as prompt_type, t.strategy,
       cast(row_number() over (partition by t.model_name, t.problem_id, t.strategy order by t.trial_index) - 1 as int) as trial_index,
       t.status, t.latency_ms, cast(t.input_tokens as double) as input_tokens, t.runtime_percentile, t.memory_percentile
from trials t left join problems p on t.problem_id = p.problem_id"""),
)

QUERIES["retry_arrays"] = (
    lambda spark, sf: crossrun.retry_from_arrays(
        nested_results(spark, sf)
    ).select("model_name", "problem_id", "needs_retry"),
    sql("select * from retry"),
)

def problems_read(spark, sf):
    """The problems written as JSON arrays in their order, and read back in splits."""
    path = shared_dir(spark, "problems")
    shown = problems(spark, sf).select(
        F.col("backend_question_id").cast("string").alias("backend_question_id"),
        F.col("frontend_question_id").cast("string").alias("frontend_question_id"),
        "title", "title_slug", "difficulty", F.col("paid_only").alias("isPaidOnly"), "seq",
    )
    json_arrays.write_array(shown, path, [F.col("seq")])
    return readers.read_problems(spark, path)


QUERIES["problem_load"] = (
    lambda spark, sf: prob.load_problems(problems_read(spark, sf), "medium", 500).select(
        "question_id", "frontend_question_id", "title_slug", "difficulty"
    ),
    sql("""select backend_question_id as question_id, frontend_question_id, title_slug, 'Medium' as difficulty
from v_problems where upper(trim(difficulty)) = 'MEDIUM' order by seq limit 500"""),
)
QUERIES["problem_slice"] = (
    lambda spark, sf: prob.select_problems(problems(spark, sf), "hard", 100, 20, True).select(
        "frontend_question_id", "title_slug", "seq"
    ),
    sql("""select frontend_question_id, title_slug, seq from v_problems where upper(trim(difficulty)) = 'HARD' and not paid_only
order by seq limit 100 offset 20"""),
)


def with_special_ids(spark, sf):
    """Some problems carry ids that are not all digits, as contest problems do."""
    special = F.contains("topics", F.lit("PROMO"))
    ident = F.when(special, F.concat(F.lit("C-"), "frontend_question_id")).otherwise(F.col("frontend_question_id"))
    return problems(spark, sf).withColumn("frontend_question_id", ident)


QUERIES["latest_problems"] = (
    lambda spark, sf: prob.latest_problems(with_special_ids(spark, sf), 40).select(
        "frontend_question_id", "frontend_id_num", "title_slug"
    ),
    sql("""select frontend_question_id, cast(frontend_question_id as bigint) as frontend_id_num, title_slug
from v_problems where not paid_only and not contains(topics, 'PROMO') order by 2 desc limit 40"""),
)
QUERIES["random_problems"] = (
    lambda spark, sf: prob.sample_problems(problems(spark, sf), 30, seed=7).select("frontend_question_id", "title_slug"),
    sql("""select frontend_question_id, title_slug from v_problems where not paid_only
order by md5(concat('7|', frontend_question_id)), frontend_question_id limit 30"""),
)
QUERIES["trial_cap"] = (
    lambda spark, sf: prob.cap_trials(trials(spark, sf), 3).select(*stability.TRIAL_KEY, "status"),
    sql("select model_name, problem_id, strategy, trial_index, status from trials where trial_index < 3"),
)
QUERIES["distinct_problems"] = (
    lambda spark, sf: trial_log(spark, sf).select("problem_id", "strategy").distinct(),
    sql("select distinct problem_id, strategy from log"),
)


def model_filter(spark, sf):
    """Requested models that are configured, and requested prompts, over the log."""
    wanted = ["model-1", "model-3", "model-11", "model-99"]
    log = prob.filter_runs(trial_log(spark, sf), wanted, ["detailed"])
    return log.groupBy("model_name", "strategy").agg(F.count(F.lit(1)).alias("rows"))


QUERIES["model_filter"] = (
    model_filter,
    sql("""select model_name, strategy, count(*) as rows from log
where model_name in ('model-1', 'model-3', 'model-11', 'model-99') and strategy in ('detailed') group by model_name, strategy"""),
)

NUMERIC_TEXT = """case when tie_7 = 'R' then 'N/A' when tie_7 = 'A' and latency_ms is null then ''
       else cast(latency_ms as string) end"""
QUERIES["numeric_coerced"] = (
    lambda spark, sf: trial_log(spark, sf).select(
        "model_name", "submission_id", "tie_1", labels.coerce_numeric(F.expr(NUMERIC_TEXT)).alias("latency")
    ),
    sql(f"select model_name, submission_id, tie_1, try_cast({NUMERIC_TEXT} as double) as latency from log"),
)

SNIPPETS = """array(named_struct('langSlug', 'cpp', 'code', title),
       named_struct('langSlug', case when paid_only then 'java' else 'python3' end, 'code', code_template),
       named_struct('langSlug', 'python3', 'code', description))"""
QUERIES["python_template"] = (
    lambda spark, sf: problems(spark, sf).select(
        "frontend_question_id", prob.python_template(F.expr(SNIPPETS)).alias("code_template")
    ),
    sql("""select frontend_question_id, case when paid_only then description else code_template end as code_template
from v_problems"""),
)


def summary_rows(spark, sf):
    p = problems(spark, sf).select(
        F.col("frontend_question_id").alias("problem_id"), "title",
        labels.clean_difficulty(F.col("difficulty")).alias("difficulty"),
    )
    rows = trials(spark, sf).join(p, "problem_id", "left").withColumns(
        {
            "timestamp": F.date_format("logged_at", "yyyy-MM-dd'T'HH:mm:ss"),
            "runtime": F.concat(F.col("trial_index").cast("string"), F.lit(" ms")),
            "memory": F.concat(F.col("tie_2").cast("string"), F.lit(" MB")),
        }
    )
    return writers.attempt_summary(rows)


QUERIES["attempt_summary"] = (
    summary_rows,
    sql("""select strftime(t.logged_at, '%Y-%m-%dT%H:%M:%S') as "Timestamp", p.title as "Problem", p.difficulty as "Difficulty",
       t.model_name as "Model", t.strategy as "Strategy", t.status as "Status", concat(cast(t.trial_index as varchar), ' ms') as "Runtime(ms)",
       concat(cast(t.tie_2 as varchar), ' MB') as "Memory(MB)", coalesce(t.latency_ms, 0.0) / 1000 as "Gen Time(s)",
       concat(cast(coalesce(t.input_tokens, 0) as varchar), '/', cast(coalesce(t.output_tokens, 0) as varchar)) as "Tokens(In/Out)",
       coalesce(t.cost, 0.0) as "Est Cost($)"
from trials t left join problems p on t.problem_id = p.problem_id"""),
)

QUERIES["solutions_md"] = (
    lambda spark, sf: view(spark, sf, "v_answers").select(
        "custom_id",
        writers.solution_block(
            F.concat(F.lit("p-"), F.col("problem_no").cast("string")), F.col("prompt_type"), F.col("response_text")
        ).alias("block"),
    ),
    sql("""select custom_id, concat('## p-', cast(problem_no as varchar), ' (', prompt_type, ')', chr(10), '```python', chr(10),
       coalesce(nullif(response_text, ''), '# No code generated'), chr(10), '```', chr(10), chr(10)) as block from v_answers"""),
)


def archives_merged(spark, sf):
    """Two machines' archives of one log, the later entry of an attempt winning."""
    log = trial_log(spark, sf)
    here, there = log.where("tie_7 <> 'R'"), log.where("tie_7 = 'R'")
    newest = [F.desc(c) for c in LOG_ORDER]
    return readers.merge_archives([here, there], stability.TRIAL_KEY, newest).select(
        *stability.TRIAL_KEY, "status", "submission_id", "tie_1"
    )


QUERIES["merge_archives"] = (
    archives_merged,
    sql(f"""select model_name, problem_id, strategy, trial_index, status, submission_id, tie_1 from (
  select *, row_number() over (partition by model_name, problem_id, strategy, trial_index
    order by {", ".join(c + " desc" for c in LOG_ORDER)}) as rn from log) t where rn = 1"""),
)


def run_ids(spark, sf):
    path = F.concat(F.lit("/runs/"), "lang", F.lit("/"), "source", F.lit(" nr+"), F.col("doc_id").cast("string"), F.lit(".v2.json"))
    return table(spark, sf, "documents").select(
        "doc_id",
        readers.run_id("qwen_batch", path, F.col("text")).alias("run_id"),
        readers.run_id("bedrock_batch", path, F.col("text"), with_path=True).alias("run_id_with_path"),
    )


_STEM = "regexp_replace(concat(source, ' nr+', cast(doc_id as varchar), '.v2'), '[^A-Za-z0-9._-]', '_', 'g')"
QUERIES["run_id"] = (
    run_ids,
    f"""select doc_id, concat('qwen_batch_', {_STEM}, '_', substr(sha1(text), 1, 10)) as run_id,
       concat('bedrock_batch_', {_STEM}, '_', substr(sha1(concat('/runs/', lang, '/', source, ' nr+', cast(doc_id as varchar), '.v2.json', chr(0), text)), 1, 10)) as run_id_with_path
from documents""",
)


def trials_read(spark, sf):
    """The log as JSON lines among bad ones, read back."""
    path = shared_dir(spark, "trials")
    log = view(spark, sf, "v_trial_log").select("model_name", "problem_id", "strategy", "trial_index", "status", "latency_ms")
    line = F.to_json(F.struct(*log.columns))
    cut = F.when(F.xxhash64(line) % 16 == 0, F.array(line, F.lit(""), F.substring(line, 1, 20))).otherwise(F.array(line))
    log.select(F.explode(cut).alias("value")).write.text(path)
    return readers.read_trials(spark, path).groupBy("model_name", "strategy", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("latency_ms") > 0).alias("timed")
    )


QUERIES["trials_read"] = (
    trials_read,
    sql("""select model_name, strategy, status, count(*) as rows, count(*) filter (where latency_ms > 0) as timed
from v_trial_log group by model_name, strategy, status"""),
)


def trial_table(spark, sf):
    """Attempts written as a table laid out for its cells; one model's cells read from it."""
    path = shared_dir(spark, "trial-table")
    name = f"trial_table_{path.rsplit('-', 1)[-1]}"
    writers.write_trial_table(trials(spark, sf).select(*stability.TRIAL_KEY, "accepted", "status"), name, path)
    return stability.cells(spark.table(name).where("model_name = 'model-3'")).drop("latencies")


QUERIES["trial_table"] = (
    trial_table,
    sql("select model_name, problem_id, strategy, n, a, first_pass, first_accepted from cells where model_name = 'model-3'"),
)


def saved_summaries(spark, sf):
    """Summaries saved twice under their names, the second time those of one prompt only with new names for some."""
    path = shared_dir(spark, "saved")
    rows = view(spark, sf, "v_summaries").groupBy(F.concat("model_name", F.lit("_"), "prompt_type").alias("experiment_name")).agg(
        F.max("run_level_pass_rate").alias("run_level_pass_rate"), F.count(F.lit(1)).alias("num_problems")
    )
    writers.save_summary(rows, path)
    again = rows.where(F.endswith("experiment_name", F.lit("minimal"))).withColumn("num_problems", F.lit(0).cast("bigint"))
    writers.save_summary(again, path)
    return spark.read.parquet(path).select("experiment_name", "run_level_pass_rate", "num_problems")


QUERIES["saved_summaries"] = (
    saved_summaries,
    sql("""select concat(model_name, '_', prompt_type) as experiment_name, max(run_level_pass_rate) as run_level_pass_rate,
       case when prompt_type = 'minimal' then 0 else count(*) end as num_problems
from v_summaries group by model_name, prompt_type"""),
)
