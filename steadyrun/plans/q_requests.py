"""Building requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from steadyrun.operators import crossrun, requests as req
from steadyrun.plans.common import STEPS, sql, trial_log
from steadyrun.plans.q_report import problems
from steadyrun.sources import readers, writers
from steadyrun.sources.scratch import shared_dir
from steadyrun.sources.tables import view

QUERIES = {}

MODELS = ["qwen-plus", "o3 mini/2", "gemini-2.5-flash"]
PROMPTS = ["detailed", "minimal"]
RUNS = 2


def grid(spark, sf):
    return req.expand_requests(problems(spark, sf), MODELS, PROMPTS, RUNS)


STEPS["grid"] = f"""
select p.*, m.model_id, q.prompt_type, cast(r.trial_index as int) as trial_index from v_problems p
join (values {", ".join(f"('{m}')" for m in MODELS)}) as m(model_id) on true
join (values ('detailed'), ('minimal')) as q(prompt_type) on true
join range(0, {RUNS}) as r(trial_index) on true
"""

QUERIES["request_grid"] = (
    lambda spark, sf: grid(spark, sf).select("frontend_question_id", "model_id", "prompt_type", "trial_index"),
    sql("select frontend_question_id, model_id, prompt_type, trial_index from grid"),
)


def ids(spark, sf):
    full = req.custom_id(*[F.col(c) for c in ("model_id", "frontend_question_id", "title_slug", "prompt_type", "trial_index")])
    return grid(spark, sf).withColumn("custom_id", full)


_CLEAN = "regexp_replace({}, '[^A-Za-z0-9._-]+', '_', 'g')"
STEPS["ids"] = f"""
select *, concat('model=', {_CLEAN.format('model_id')}, '|problem=', {_CLEAN.format('frontend_question_id')}, '|slug=',
       {_CLEAN.format('title_slug')}, '|prompt=', {_CLEAN.format('prompt_type')}, '|trial=', cast(trial_index as varchar)) as custom_id
from grid
"""
QUERIES["custom_ids"] = (
    lambda spark, sf: ids(spark, sf).select("custom_id", req.hashed_custom_id(F.col("custom_id")).alias("hashed_id")),
    sql("select custom_id, sha1(custom_id) as hashed_id from ids"),
)


def id_parts(spark, sf):
    parts = req.parse_custom_id(F.col("custom_id"))
    return view(spark, sf, "v_manifest").select(
        "doc_id", *[parts[k].alias(k) for k in ("model", "problem", "slug", "prompt", "trial")]
    )


QUERIES["custom_id_parts"] = (
    id_parts,
    sql("""select doc_id, model_id as model, problem_id as problem, title_slug as slug, prompt_type as prompt,
       cast(trial_index as varchar) as trial from v_manifest"""),
)


def rendered(spark, sf):
    prompt = req.render_by_type(F.col("prompt_type"), F.col("description"), F.col("code_template"))
    return ids(spark, sf).withColumn("prompt", prompt)


def _template_sql(kind: str) -> str:
    text = req.TEMPLATES[kind].replace("'", "''")
    before, rest = text.split("{problem_description}")
    middle, after = rest.split("{code_template}")
    return f"concat('{before}', description, '{middle}', code_template, '{after}')"


STEPS["rendered"] = f"""
select *, case when prompt_type = 'detailed' then {_template_sql("detailed")} else {_template_sql("minimal")} end as prompt from ids
"""
QUERIES["prompts_rendered"] = (
    lambda spark, sf: rendered(spark, sf).select("custom_id", "prompt"),
    sql("select custom_id, prompt from rendered"),
)

# Models that stand for the nine body shapes, by the kind of part.
SHAPE_MODELS = {
    "qwen-plus": "chat", "o4-mini": "chat_reasoning", "us.anthropic.claude-x": "claude",
    "amazon.nova-pro": "nova", "meta.llama3-70b": "llama", "us.deepseek.r1": "deepseek",
    "gemini-2.5-flash": "generate", "claude-sonnet": "tool", "mistral:large": "generic",
}


def bodies(spark, sf):
    """Bodies of all shapes over all problems, with the fields that matter read back from the JSON."""
    rows = req.expand_requests(problems(spark, sf), list(SHAPE_MODELS), ["minimal"], 1).withColumn(
        "prompt", req.render_prompt(req.TEMPLATES["minimal"], F.col("description"), F.col("code_template"))
    )
    rows = rows.withColumn("shape", req.shape_of(F.col("model_id"))).withColumn(
        "body",
        req.request_body(
            F.col("shape"), model=F.col("model_id"), prompt=F.col("prompt"), temperature=F.lit(0.3),
            top_p=F.lit(0.9), max_tokens=F.lit(4096), thinking_tokens=(F.col("seq") % 3 * 1024).cast("int"),
        ),
    )

    def back(*paths):
        return F.coalesce(*[F.try_variant_get("parsed", p, "string") for p in paths])

    return rows.withColumn("parsed", F.parse_json("body")).select(
        "frontend_question_id", "model_id", "shape",
        F.md5(
            back(
                "$.messages[1].content", "$.messages[0].content[0].text", "$.messages[0].content", "$.prompt",
                "$.contents[0].parts[0].text",
            )
        ).alias("prompt_md5"),
        back(
            "$.max_tokens", "$.max_completion_tokens", "$.inferenceConfig.max_new_tokens", "$.max_gen_len",
            "$.generationConfig.maxOutputTokens",
        ).cast("int").alias("token_limit"),
        back("$.temperature", "$.inferenceConfig.temperature", "$.generationConfig.temperature").cast("double").alias("temperature"),
        back("$.generationConfig.thinkingConfig.thinkingBudget").cast("int").alias("thinking_budget"),
        back("$.tool_choice.name").alias("tool"),
    )


def _quoted(text: str) -> str:
    return "concat(" + ", chr(10), ".join(f"'{part}'" for part in text.split("\n")) + ")"


def _wrapped(shape: str) -> str:
    """The prompt as the body of a shape has it, as SQL."""
    return f"""case {shape} when 'llama' then concat({_quoted(req.LLAMA_SYSTEM + req.SYSTEM + req.LLAMA_USER)}, prompt, {_quoted(req.LLAMA_END)})
  when 'generic' then concat({_quoted(req.SYSTEM)}, chr(10), chr(10), prompt) else prompt end"""


QUERIES["request_bodies"] = (
    bodies,
    sql(f"""select frontend_question_id, model_id, shape, md5({_wrapped('shape')}) as prompt_md5,
       case when shape = 'generate' then cast(16384 + seq % 3 * 1024 as int) else 4096 end as token_limit,
       case when shape = 'chat_reasoning' then null else 0.3e0 end as temperature,
       case when shape = 'generate' then cast(seq % 3 * 1024 as int) end as thinking_budget,
       case when shape = 'tool' then 'submit_solution' end as tool
from (select p.*, m.model_id, m.shape, {_template_sql("minimal")} as prompt from v_problems p
      join (values {", ".join(f"('{m}', '{s}')" for m, s in SHAPE_MODELS.items())}) as m(model_id, shape) on true) t"""),
)


def shaped(spark, sf):
    """Whole documents as prompts, each asked of one of the models that stand for the shapes."""
    models = F.array(*map(F.lit, SHAPE_MODELS))
    m = view(spark, sf, "v_manifest").withColumn("model_id", F.get(models, (F.col("doc_id") % len(SHAPE_MODELS)).cast("int")))
    m = m.withColumn("shape", req.shape_of(F.col("model_id")))
    body = req.request_body(
        F.col("shape"), model=F.col("model_id"), prompt=F.col("prompt"), temperature=F.lit(0.3), top_p=F.lit(0.9),
        max_tokens=F.lit(4096), thinking_tokens=F.lit(0),
    )
    return m.withColumn("body", body)


def request_lines(spark, sf):
    """Request lines of all shapes as ASCII JSON, with id and prompt read back from the line."""
    lines = shaped(spark, sf).select(
        "doc_id", "shape", req.request_envelope(F.col("shape"), F.col("custom_id"), F.col("body")).alias("line")
    )

    def back(*paths):
        return F.coalesce(*[F.get_json_object("line", p) for p in paths])

    prompt = back(
        "$.body.messages[1].content", "$.params.messages[0].content", "$.request.contents[0].parts[0].text",
        "$.modelInput.prompt", "$.modelInput.messages[1].content", "$.modelInput.messages[0].content[0].text",
        "$.modelInput.messages[0].content",
    )
    return lines.select(
        "doc_id", "shape", back("$.custom_id", "$.recordId").alias("custom_id"), F.md5(prompt).alias("prompt_md5"),
        (F.length("line") == F.octet_length("line")).alias("is_ascii"),
        F.contains("line", F.lit("\n")).alias("has_newline"),
    )


_SHAPED = f"""(select v.*, list_extract([{", ".join(f"'{s}'" for s in SHAPE_MODELS.values())}], cast(doc_id % {len(SHAPE_MODELS)} as int) + 1) as shape from v_manifest v)"""
QUERIES["request_jsonl"] = (
    request_lines,
    sql(f"""select doc_id, shape, case when shape <> 'generate' then custom_id end as custom_id,
       md5({_wrapped("shape")}) as prompt_md5, true as is_ascii, false as has_newline from {_SHAPED} t"""),
)


def manifest_lines(spark, sf):
    """The manifest of those requests written as JSON lines and read back."""
    path = shared_dir(spark, "manifest")
    writers.write_manifest(req.manifest_rows(shaped(spark, sf)), path)
    back = readers.read_manifest_lines(spark, path)
    return back.select("custom_id", "problem_id", "title_slug", "prompt_type", "trial_index", "prompt_hash")


QUERIES["manifest_load"] = (
    manifest_lines,
    sql(f"""select custom_id, problem_id, title_slug, prompt_type, trial_index,
       case when shape = 'generate' then prompt_hash end as prompt_hash from {_SHAPED} t"""),
)

THINK_MODELS = ["gemini-3-pro-preview", "Gemini-2.5-Flash", "gemini-2.0-flash", "gpt-4o"]
QUERIES["thinking_config"] = (
    lambda spark, sf: req.expand_requests(problems(spark, sf), THINK_MODELS, ["detailed"], 1).select(
        "frontend_question_id", "model_id",
        req.thinking_config(F.col("model_id"), (F.col("seq") % 4 * 512).cast("int")).alias("thinking_config"),
    ),
    sql(f"""select frontend_question_id, m.model_id,
       case when lower(m.model_id) like 'gemini-3%' then case when seq % 4 > 0 then '{{"thinkingLevel":"HIGH"}}' else '{{"thinkingLevel":"LOW"}}' end
            when lower(m.model_id) like 'gemini-2.5%' then concat('{{"thinkingBudget":', cast(seq % 4 * 512 as varchar), '}}') end as thinking_config
from v_problems join (values {", ".join(f"('{m}')" for m in THINK_MODELS)}) as m(model_id) on true"""),
)
QUERIES["prompt_hash"] = (
    lambda spark, sf: view(spark, sf, "v_manifest").select(
        "custom_id", req.prompt_hash(F.col("prompt"), F.col("trial_index")).alias("prompt_hash")
    ),
    sql("select custom_id, prompt_hash from v_manifest"),
)


def job_names(spark, sf):
    run = F.concat(F.lit("run_2025 "), F.col("experiment_name"), F.lit("~"), F.coalesce("generation_mode", F.lit("none")))
    rows = view(spark, sf, "v_summaries")
    return rows.select(
        "seq", *[req.job_name(run, F.col("model_name"), F.col("prompt_type"), n).alias(f"name_{n}") for n in (30, 63, 128)]
    )


_RAW = f"""regexp_replace(concat_ws('-', {_CLEAN.format("concat('run_2025 ', experiment_name, '~', coalesce(generation_mode, 'none'))")},
  {_CLEAN.format('model_name')}, prompt_type), '[^A-Za-z0-9-]+', '-', 'g')"""
QUERIES["job_names"] = (
    job_names,
    sql("select seq, " + ", ".join(f"rtrim(substr({_RAW}, 1, {n}), '-') as name_{n}" for n in (30, 63, 128)) + " from v_summaries"),
)


def pending(spark, sf):
    """Cells of the log whose (model, prompt) has no job, or whose latest job failed."""
    latest = crossrun.latest_state(view(spark, sf, "v_job_state"), ["model_id", "prompt_type"], ["status"])
    jobs = latest.where("status <> 'failed'").select(
        F.col("model_id").alias("model_name"), F.col("prompt_type").alias("strategy")
    )
    requests = trial_log(spark, sf).select("model_name", "problem_id", "strategy").distinct()
    return req.pending_requests(requests, jobs, ["model_name", "strategy"])


QUERIES["pending_requests"] = (
    pending,
    sql("""with jobs as (select model_id, prompt_type from (
    select *, row_number() over (partition by model_id, prompt_type order by ts desc, event_id desc) as rn from v_job_state) t
  where rn = 1 and status <> 'failed')
select distinct model_name, problem_id, strategy from log l where not exists (
  select 1 from jobs j where j.model_id = l.model_name and j.prompt_type = l.strategy)"""),
)
