"""Reading raw answers, classifying them, and joining them back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steadyrun.functions import codetext
from steadyrun.operators import answers as ans, requests as req
from steadyrun.plans.common import STEPS, sql
from steadyrun.sources import readers
from steadyrun.sources.scratch import shared_dir
from steadyrun.sources.tables import table, view

QUERIES = {}


def answers(spark, sf):
    return view(spark, sf, "v_answers")


def chat_lines(df):
    """Chat-completion lines: odd documents answer in a list of parts, errors come in two places."""
    text = F.coalesce("response_text", F.lit(""))
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    usage = F.struct(
        F.col("input_tokens").alias("prompt_tokens"),
        F.when(F.col("output_tokens") % 5 > 0, F.col("output_tokens")).alias("completion_tokens"),
    )

    def body(content: Column) -> Column:
        message = F.struct(content.alias("content"))
        return F.struct(F.array(F.struct(message.alias("message"))).alias("choices"), usage.alias("usage"))

    def line(content: Column) -> Column:
        failed = F.when(F.col("error").isNotNull(), F.struct(F.col("error").alias("code")))
        response = F.struct(body(content).alias("body"))
        return F.to_json(F.struct("custom_id", failed.alias("error"), response.alias("response")))

    listed = F.array(part, image, F.struct(F.lit("text").alias("type"), F.lit("--").alias("text")))
    value = F.when(F.col("doc_id") % 2 == 1, line(listed)).otherwise(line(text))
    return df.select("custom_id", "doc_id", "model_id", value.alias("value")).drop("custom_id")


PARTS = "case when doc_id % 2 = 1 then concat(coalesce(response_text, ''), chr(10), '--') else coalesce(response_text, '') end"
OUT_TOKENS = "case when output_tokens % 5 > 0 then output_tokens else 0 end"
QUERIES["chat_text"] = (
    lambda spark, sf: ans.chat_answers(chat_lines(answers(spark, sf))).select(
        "custom_id", "text", "input_tokens", "output_tokens", "error"
    ),
    sql(f"""select custom_id, {PARTS} as text, input_tokens, {OUT_TOKENS} as output_tokens,
       case when error is not null then concat('{{"code":"', error, '"}}') end as error from v_answers"""),
)

# One model of each family, by document.
FAMILY = """case doc_id % 5 when 0 then 'anthropic.claude-3-haiku-20240307-v1:0' when 1 then 'amazon.nova-pro'
  when 2 then 'meta.llama3-70b' when 3 then 'us.DeepSeek.r1' else 'other-family' end"""


def model_output_lines(df):
    text = F.coalesce("response_text", F.lit(""))
    i, o = F.col("input_tokens"), F.col("output_tokens")

    def struct(**fields: Column) -> Column:
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    said = struct(type=F.lit("text"), text=text)
    other = struct(type=F.lit("thinking"), text=F.lit("hidden"))
    outputs = {
        0: struct(content=F.array(other, said), usage=struct(input_tokens=i, output_tokens=o)),
        1: struct(
            output=struct(message=struct(content=F.array(struct(text=text), struct(text=F.lit("end"))))),
            usage=struct(inputTokens=i, outputTokens=o),
        ),
        2: struct(generation=text, prompt_token_count=i, generation_token_count=o),
        3: struct(
            choices=F.array(struct(message=struct(content=text))),
            usage=struct(prompt_tokens=F.lit(0), input_tokens=i, completion_tokens=o),
        ),
        4: struct(completion=F.lit(""), generated_text=text, text=F.lit("last"), usage=struct(prompt_tokens=i)),
    }
    value = None
    for n, output in outputs.items():
        line = F.to_json(F.struct(F.col("custom_id").alias("recordId"), output.alias("modelOutput"), F.col("error")))
        on = F.col("doc_id") % 5 == n
        value = F.when(on, line) if value is None else value.when(on, line)
    return df.select(F.expr(FAMILY).alias("model_id"), "doc_id", value.alias("value"))


QUERIES["family_text"] = (
    lambda spark, sf: ans.model_output_answers(
        model_output_lines(answers(spark, sf)), F.col("model_id")
    ).select("custom_id", "model_id", "text", "input_tokens", "output_tokens", "error"),
    sql(f"""select custom_id, {FAMILY} as model_id,
       case doc_id % 5 when 1 then concat(coalesce(response_text, ''), chr(10), 'end')
            when 4 then coalesce(nullif(response_text, ''), 'last') else coalesce(response_text, '') end as text,
       input_tokens, case when doc_id % 5 = 4 then 0 else output_tokens end as output_tokens, error from v_answers"""),
)


def broken_json(spark, sf):
    """Whole documents as JSON answers: well formed, broken by raw newlines, or plain text."""
    escaped = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    broken = F.concat(F.lit('{"code" : "'), escaped, F.lit('\\n#\\t\\q", "n": 1}'))
    raw = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("code"))))
        .when(F.col("doc_id") % 3 == 1, broken)
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"))


QUERIES["structured_code"] = (
    lambda spark, sf: broken_json(spark, sf).select("doc_id", codetext.structured_code(F.col("raw")).alias("code")),
    """select doc_id, case when doc_id % 3 = 1 then concat(replace(text, chr(10), ''), chr(10), '#', chr(9), '\\q') else text end as code
from documents""",
)


def grid(spark, sf):
    """The manifest asked of two models."""
    return view(spark, sf, "v_manifest").withColumn("model_id", F.explode(F.array(F.lit("model-a"), F.lit("model-b"))))


def generate_lines(spark, sf):
    """Generate-content lines over the manifest; every seventh one echoes a prompt nobody asked."""
    m = grid(spark, sf)
    asked = req.tagged_prompt(F.col("prompt"), F.col("trial_index"))
    echo = F.when(F.col("doc_id") % 7 == 0, F.concat(asked, F.lit("?"))).otherwise(asked)
    contents = F.array(
        F.struct(F.lit("model").alias("role"), F.array(F.struct(F.lit("hello").alias("text"))).alias("parts")),
        F.struct(
            F.lit("user").alias("role"),
            F.array(F.struct(F.lit("").alias("text")), F.struct(echo.alias("text"))).alias("parts"),
        ),
    )
    code = F.to_json(F.struct(F.col("prompt").alias("code")))
    candidates = F.array(
        F.struct(F.struct(F.array(F.struct(code.alias("text"))).alias("parts")).alias("content"))
    )
    usage = F.struct(F.length("prompt").alias("promptTokenCount"), F.lit(None).cast("int").alias("candidatesTokenCount"))
    line = F.struct(
        F.when(F.col("doc_id") % 11 == 0, F.lit("quota")).otherwise(F.lit("")).alias("status"),
        F.struct(contents.alias("contents")).alias("request"),
        F.when(F.col("doc_id") % 13 != 0, F.struct(candidates.alias("candidates"), usage.alias("usageMetadata"))).alias("response"),
    )
    return m.select("doc_id", "model_id", F.to_json(line).alias("value"))


def hash_match(spark, sf):
    parsed = ans.generate_answers(generate_lines(spark, sf)).drop("value")
    found = ans.match_by_hash(parsed, grid(spark, sf), "doc_id", "doc_id")
    return found.select("model_id", "prompt_hash", "custom_id", "doc_id", "text", "answers_of_hash", "requests_of_hash", "input_tokens", "output_tokens", "error")


QUERIES["hash_match"] = (
    hash_match,
    sql("""with lines as (select doc_id, prompt,
       md5(concat(prompt, chr(10), '<!-- trial=', cast(trial_index as varchar), ' -->', case when doc_id % 7 = 0 then '?' else '' end)) as prompt_hash
     from v_manifest),
last as (select *, row_number() over (partition by prompt_hash order by doc_id desc) as rn,
         count(*) over (partition by prompt_hash) as answers_of_hash from lines),
keyed as (select prompt_hash, custom_id, row_number() over (partition by prompt_hash order by doc_id desc) as rn,
          count(*) over (partition by prompt_hash) as requests_of_hash from v_manifest)
select model_id, l.prompt_hash, k.custom_id, l.doc_id, answers_of_hash, requests_of_hash, case when doc_id % 13 = 0 then '' else prompt end as text,
       case when doc_id % 13 = 0 then 0 else length(prompt) end as input_tokens, cast(0 as bigint) as output_tokens,
       case when doc_id % 11 = 0 then 'quota' when doc_id % 13 = 0 then 'No response from the service' end as error
from (select * from last cross join (values ('model-a'), ('model-b')) m(model_id)) l
left join keyed k on l.prompt_hash = k.prompt_hash and k.rn = 1 where l.rn = 1"""),
)


def message_lines(df):
    text = F.coalesce("response_text", F.lit(""))

    def block(kind: str, name: Column, said: Column, code: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), name.alias("name"), said.alias("text"), F.struct(code.alias("code")).alias("input")
        )

    none = F.lit(None).cast("string")
    talk = block("text", none, F.concat(F.lit("I say "), text), none)
    tool = block("tool_use", F.lit("submit_solution"), none, text)
    other = block("tool_use", F.lit("search"), none, F.lit("x"))
    content = F.when(F.col("doc_id") % 3 == 0, F.array(talk, other)).otherwise(F.array(talk, other, tool, tool))
    kind = (
        F.when(F.col("error").isNotNull(), F.lit("errored"))
        .when(F.col("doc_id") % 17 == 0, F.lit("expired"))
        .otherwise(F.lit("succeeded"))
    )
    message = F.struct(content.alias("content"), F.struct("input_tokens", "output_tokens").alias("usage"))
    result = F.struct(kind.alias("type"), F.col("error"), F.when(kind == "succeeded", message).alias("message"))
    return df.select("doc_id", "model_id", F.to_json(F.struct("custom_id", result.alias("result"))).alias("value"))


QUERIES["tool_text"] = (
    lambda spark, sf: ans.message_answers(message_lines(answers(spark, sf))).select(
        "custom_id", "text", "input_tokens", "output_tokens", "error"
    ),
    sql("""select custom_id, case when error is not null or doc_id % 17 = 0 then '' when doc_id % 3 = 0 then concat('I say ', coalesce(response_text, ''))
            else coalesce(response_text, '') end as text,
       case when error is not null or doc_id % 17 = 0 then 0 else input_tokens end as input_tokens,
       case when error is not null or doc_id % 17 = 0 then 0 else output_tokens end as output_tokens,
       case when error is not null then error when doc_id % 17 = 0 then 'expired' end as error from v_answers"""),
)


def usage(spark, sf):
    """Token counts that come as numbers, text, null, zero with a fallback, or not at all."""
    a = answers(spark, sf)
    first = F.expr("case doc_id % 4 when 0 then cast(input_tokens as string) when 1 then '0' when 2 then null else 'many' end")
    return a.select(
        "custom_id",
        ans.tokens(first, F.col("output_tokens")).alias("input_tokens"),
        ans.tokens(first).alias("input_tokens_alone"),
    )


QUERIES["usage_tokens"] = (
    usage,
    sql("""select custom_id, case when doc_id % 4 = 0 and input_tokens > 0 then input_tokens else output_tokens end as input_tokens,
       case when doc_id % 4 = 0 then input_tokens else 0 end as input_tokens_alone from v_answers"""),
)

# Known code of each kind of answer. A plain document is code only if a line of it starts like code.
CODE_LINE = r"(?m)^\s*(def|class|import|from|return) [^\n]*\S"
STEPS["coded"] = f"""
select *, case variant
    when 0 then concat('class Solution:', chr(10), '    def f(self):', chr(10), '        return 1')
    when 1 then concat('class Solution:', chr(10), '    x = 1')
    when 2 then case when regexp_matches(text, '{CODE_LINE}') then trim(text, concat(' ', chr(10), chr(9), chr(13))) end
    when 4 then concat('class Solution', chr(10), '    x = 1')
    when 5 then concat('import os', chr(10), 'print(1)', chr(10), rtrim(concat('# ', replace(text, chr(10), concat(chr(10), '# '))), concat(' ', chr(10), chr(9), chr(13))))
    when 7 then 'x = 2' end as code
from v_answers
"""
QUERIES["code_extracted"] = (
    lambda spark, sf: answers(spark, sf).select(
        "custom_id", codetext.extract_code(F.col("response_text")).alias("code")
    ),
    sql("select custom_id, code from coded"),
)
QUERIES["syntax_gate"] = (
    lambda spark, sf: answers(spark, sf)
    .select("custom_id", codetext.extract_code(F.col("response_text")).alias("code"))
    .select("custom_id", codetext.is_valid_python(F.col("code")).alias("valid")),
    sql("select custom_id, case when code is not null then variant in (0, 1, 5, 7) end as valid from coded"),
)
PRICES = " ".join(
    f"when '{m}' then (input_tokens * cast({i:.8f} as double) + output_tokens * cast({o:.8f} as double)) / 1000" for m, (i, o) in ans.PRICING.items()
)
QUERIES["token_cost"] = (
    lambda spark, sf: ans.priced(answers(spark, sf)).select("custom_id", "model_id", F.round("cost", 9).alias("cost")),
    sql(f"select custom_id, model_id, round(case model_id {PRICES} else 0.0e0 end, 9) as cost from v_answers"),
)


def generations(spark, sf):
    """Chat answers parsed, priced and classified."""
    return ans.classify(ans.priced(ans.chat_answers(chat_lines(answers(spark, sf)))))


STATUS = """case when error is not null or coalesce(response_text, '') = '' then 'Generation Failed'
  when code is null then 'Extraction Failed' when variant in (0, 1, 5, 7) then 'Success' else 'Syntax Error' end"""
# The same answers as plain strings, without the second text part that chat lines carry.
QUERIES["generation_status"] = (
    lambda spark, sf: ans.classify(
        answers(spark, sf).withColumnRenamed("response_text", "text_").drop("text").withColumnRenamed("text_", "text")
    ).select("custom_id", "status", "gen_status", "code", "error", "input_tokens", "output_tokens"),
    sql(f"""select custom_id, {STATUS} as status,
       case when error is not null or coalesce(response_text, '') = '' then 'Error' else 'Success' end as gen_status,
       case when error is null then code end as code,
       case when error is not null then error when coalesce(response_text, '') = '' then 'Empty batch response'
            when code is null then 'Failed to extract code from batch response' when variant in (0, 1, 5, 7) then null
            else 'Invalid Python syntax' end as error,
       case when error is null then input_tokens else 0 end as input_tokens,
       case when error is null then output_tokens else 0 end as output_tokens from coded"""),
)
# A tool hands in its text as code, fences, prose and all; only the commented document compiles.
QUERIES["generation_status_tools"] = (
    lambda spark, sf: ans.classify(
        ans.message_answers(message_lines(answers(spark, sf))), extracted=False
    ).select("custom_id", "status", "gen_status", "error", "input_tokens"),
    sql("""with t as (select custom_id, input_tokens,
         case when error is not null then error when doc_id % 17 = 0 then 'expired' end as failed,
         doc_id % 3 <> 0 and coalesce(response_text, '') = '' as empty, doc_id % 3 <> 0 and variant = 5 as good
       from v_answers)
select custom_id, case when failed is not null or empty then 'Generation Failed' when good then 'Success' else 'Syntax Error' end as status,
       case when failed is not null or empty then 'Error' else 'Success' end as gen_status,
       case when failed is not null then failed when empty then 'Empty batch response' when good then null else 'Invalid Python syntax' end as error,
       case when failed is not null then 0 else input_tokens end as input_tokens from t"""),
)


def resolved(spark, sf):
    """Answers of all documents, with errors logged for some of them before and after."""
    a = answers(spark, sf).select("custom_id", "doc_id", F.lit("output").alias("source"))
    again = a.where("doc_id % 4 = 1").withColumn("doc_id", F.col("doc_id") + 1)
    errors = view(spark, sf, "v_manifest").select("custom_id", "doc_id", F.lit("error").alias("source"))
    return ans.resolve(a.unionByName(again), errors, ["doc_id"])


QUERIES["answer_resolution"] = (
    resolved,
    sql("""select m.custom_id, case when a.doc_id is null then m.doc_id when a.doc_id % 4 = 1 then a.doc_id + 1 else a.doc_id end as doc_id,
       case when a.doc_id is null then 'error' else 'output' end as source
from v_manifest m left join v_answers a on m.custom_id = a.custom_id"""),
)


def completed(spark, sf):
    found = generations(spark, sf).select("custom_id", "status", "gen_status", "error", "input_tokens", "output_tokens", "cost")
    manifest = view(spark, sf, "v_manifest").select(
        "custom_id", "model_id", "problem_id", "prompt_type", "trial_index", "title_slug"
    )
    return ans.complete(manifest, found)


# Chat lines of odd documents end in a second part, which turns plain import answers into broken code.
STEPS["finished"] = f"""
select m.custom_id, m.model_id, m.problem_id, m.prompt_type, m.trial_index, m.title_slug,
       case when a.doc_id is null or a.error is not null then 'Generation Failed'
            when a.variant = 3 then 'Extraction Failed'
            when a.variant = 2 and a.code is null then 'Extraction Failed'
            when a.variant in (0, 7) then 'Success'
            when a.variant in (1, 5) then 'Syntax Error' else 'Syntax Error' end as status,
       case when a.doc_id is null or a.error is not null then 0 else a.input_tokens end as input_tokens
from v_manifest m left join coded a on m.custom_id = a.custom_id
"""
QUERIES["missing_results"] = (
    lambda spark, sf: completed(spark, sf).select("custom_id", "status", "input_tokens"),
    sql("select custom_id, status, input_tokens from finished"),
)


def strict(spark, sf):
    done = completed(spark, sf).select("custom_id", "status", "input_tokens")
    manifest = view(spark, sf, "v_manifest").select("custom_id", "problem_id", "prompt_type", "trial_index")
    return ans.join_manifest(manifest, done)


QUERIES["manifest_join"] = (
    strict,
    sql("select custom_id, problem_id, prompt_type, trial_index, status, input_tokens from finished"),
)


def items(spark, sf):
    built = ans.assemble_items(completed(spark, sf), ["model_id", "problem_id"], ["status"], size=2)
    return built.select(
        "model_id", "problem_id", "chunk",
        *[
            F.array_join(F.transform(c, lambda a: F.concat(a.trial_index.cast("string"), F.lit(":"), a.status)), ",").alias(c)
            for c in ("with_prompt", "without_prompt")
        ],
    )


_LISTED = "coalesce(string_agg(concat(cast(trial_index as varchar), ':', status), ',' order by trial_index) filter (where prompt_type = '{}'), '')"
QUERIES["generated_items"] = (
    items,
    sql(f"""select model_id, problem_id, chunk, {_LISTED.format('detailed')} as with_prompt, {_LISTED.format('minimal')} as without_prompt
from (select *, (row_number() over (partition by model_id, problem_id, prompt_type order by trial_index, status) - 1) // 2 as chunk
      from finished) f group by model_id, problem_id, chunk"""),
)


def batch_lines(spark, sf):
    """Chat lines written as text among blank and cut-off lines, and read back from all shards."""
    lines = chat_lines(answers(spark, sf))
    whole = F.length("value")
    bad = F.array(F.col("value"), F.lit(""), F.lit("   "), F.expr("left(value, length(value) - 1)"))
    path = shared_dir(spark, "batch-output")
    lines.where(whole > 0).select(F.explode(bad).alias("value")).write.text(path)
    return ans.chat_answers(readers.read_batch_outputs(spark, path)).select("custom_id", "input_tokens")


QUERIES["batch_output_load"] = (batch_lines, sql("select custom_id, input_tokens from v_answers"))


def failed(spark, sf):
    requests = view(spark, sf, "v_manifest").select("custom_id", "problem_id")
    errors = answers(spark, sf).where("error is not null").select("custom_id")
    unknown = errors.select(F.concat("custom_id", F.lit("|old")).alias("custom_id"))
    return ans.failed_requests(requests, errors.unionByName(errors).unionByName(unknown))


QUERIES["failed_requests"] = (
    failed,
    sql("""select m.custom_id, m.problem_id, true as found from v_manifest m join v_answers a on m.custom_id = a.custom_id where a.error is not null
union all select concat(custom_id, '|old'), null, false from v_answers where error is not null"""),
)


def retries(spark, sf):
    """A retry of everything that failed or never came; half of it fails again."""
    a = answers(spark, sf).select("custom_id", F.col("response_text").alias("answer"), "error")
    wanted = view(spark, sf, "v_manifest").select("custom_id", "doc_id").join(
        a.where("error is null").select("custom_id"), "custom_id", "left_anti"
    )
    retry = wanted.select(
        "custom_id",
        F.when(F.col("doc_id") % 2 == 0, F.lit("second try")).alias("answer"),
        F.when(F.col("doc_id") % 2 == 1, F.lit("again")).alias("error"),
    )
    return a, retry


def retry_merge(spark, sf):
    a, retry = retries(spark, sf)
    merged = ans.merge_retry(a.where("error is null"), retry).select("custom_id", "answer", F.lit("output").alias("kind"))
    errors = ans.remaining_errors(a.where("error is not null").select("custom_id", "error"), retry)
    return merged.unionByName(
        errors.select("custom_id", F.col("error").alias("answer"), F.lit("error").alias("kind"))
    )


QUERIES["retry_merge"] = (
    retry_merge,
    sql("""with tried as (select m.custom_id, case when m.doc_id % 2 = 0 then 'second try' end as answer,
         case when m.doc_id % 2 = 1 then 'again' end as error
       from v_manifest m where not exists (select 1 from v_answers a where a.custom_id = m.custom_id and a.error is null))
select custom_id, response_text as answer, 'output' as kind from v_answers where error is null
union all select custom_id, answer, 'output' from tried where error is null
union all select a.custom_id, 'again', 'error' from v_answers a join tried r on a.custom_id = r.custom_id
  where a.error is not null and r.error is not null"""),
)

RAW_VERDICT = """
select event_id, case event_type when 'view' then 'PENDING' when 'error' then 'FAILURE' else 'SUCCESS' end as state,
       case when event_type = 'signup' then null else cast(event_id as string) end as submission_id,
       (event_type <> 'click') as has_result,
       case when value > 100 then null when value > 10 then 'Accepted' else 'Wrong Answer' end as status_msg,
       case when value > 50 then null else concat(cast(user_id as string), ' ms') end as status_runtime,
       concat(cast(user_id as string), ' MB') as status_memory, value as runtime_percentile, value / 2 as memory_percentile,
       user_id as total_correct, user_id + 1 as total_testcases, props as code_output,
       cast(null as string) as compile_error, cast(null as string) as runtime_error, cast(null as string) as full_runtime_error
from events
"""
STEPS["raw_verdict"] = RAW_VERDICT


def verdict_rows(spark, sf):
    raw = spark.sql(RAW_VERDICT.replace("from events", "from {events}"), events=table(spark, sf, "events"))
    return ans.verdicts(raw)


_OK = "submission_id is not null and has_result and state = 'SUCCESS'"
QUERIES["verdict_shape"] = (
    verdict_rows,
    sql(f"""select event_id, submission_id,
       case when submission_id is null then 'Submission Failed' when not has_result then 'Submission Result Missing'
            when state = 'SUCCESS' then coalesce(status_msg, 'Unknown') when state = 'FAILURE' then 'Error' else 'Timeout' end as status,
       case when {_OK} then coalesce(status_runtime, '0') end as runtime, case when {_OK} then coalesce(status_memory, '0') end as memory,
       case when submission_id is not null and has_result and state = 'FAILURE' then coalesce(status_msg, 'Unknown error') end as error,
       case when {_OK} then runtime_percentile end as runtime_percentile, case when {_OK} then memory_percentile end as memory_percentile,
       case when {_OK} then total_correct end as total_correct, case when {_OK} then total_testcases end as total_testcases,
       case when {_OK} then code_output end as code_output, case when {_OK} then '' end as compile_error,
       case when {_OK} then '' end as runtime_error, case when {_OK} then '' end as full_runtime_error from raw_verdict"""),
)
