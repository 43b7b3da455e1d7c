"""Normalising raw batch answers into one generation table, and joining it back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.functions import codetext, labels
from steadyrun.functions.spread import positions
from steadyrun.operators.requests import CODE_TOOL
from steadyrun.operators.stability import first_per_key
from steadyrun.sources import schemas

# USD per 1,000 tokens (input, output); a model not listed costs the default.
PRICING = {
    "anthropic.claude-3-5-sonnet-20240620-v1:0": (0.003, 0.015),
    "anthropic.claude-3-haiku-20240307-v1:0": (0.00025, 0.00125),
    "gpt-4o": (0.005, 0.015),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "gemini-1.5-pro": (0.0035, 0.0105),
    "gemini-1.5-flash": (0.000075, 0.0003),
    "grok-beta": (0.005, 0.015),
    "qwen-plus": (0.0, 0.0),
}
DEFAULT_PRICE = (0.0, 0.0)


def tokens(*options: Column) -> Column:
    """The first count that is a number other than 0; 0 when there is none."""
    counts = [F.nullif(c.try_cast("bigint"), F.lit(0)) for c in options]
    return F.coalesce(*counts, F.lit(0).cast("bigint"))


def error_text(error: Column) -> Column:
    """An error of any JSON type as text; empty ones are no error."""
    text = error.cast("string")
    return F.when(~text.isin("", "{}", "[]", "0", "false", "null"), text)


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), "\n")


def chat_answers(lines: DataFrame, line: str = "value") -> DataFrame:
    """Chat-completion lines: text is a string or a list of text parts."""
    parsed = lines.withColumn("__a", F.from_json(line, schemas.CHAT_LINE))
    body = F.col("__a.response.body")
    content = F.get(body.choices, F.lit(0)).message.content
    parts = F.try_variant_get(content, "$", "array<struct<type string, text string>>")
    texts = F.transform(F.filter(parts, lambda p: p.type == "text"), lambda p: p.text)
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return parsed.withColumns(
        {
            "custom_id": F.col("__a.custom_id"),
            "text": F.coalesce(plain, _joined(texts), F.lit("")),
            "input_tokens": tokens(body.usage.prompt_tokens),
            "output_tokens": tokens(body.usage.completion_tokens),
            "error": F.coalesce(error_text(F.col("__a.error")), error_text(body.error)),
        }
    ).drop("__a")


def model_output_answers(lines: DataFrame, model: Column, line: str = "value") -> DataFrame:
    """Model-output lines, read by the family of the model that wrote them."""
    parsed = lines.withColumn("__a", F.from_json(line, schemas.MODEL_OUTPUT_LINE))
    out, usage = F.col("__a.modelOutput"), F.col("__a.modelOutput.usage")
    low = F.lower(model)
    claude = F.contains(model, F.lit("anthropic.claude"))
    nova = F.contains(model, F.lit("amazon.nova"))
    llama = F.contains(model, F.lit("meta.llama"))
    deepseek = F.contains(low, F.lit("deepseek"))

    claude_text = _joined(
        F.transform(F.filter(out.content, lambda p: p.type == "text"), lambda p: p.text)
    )
    nova_text = _joined(F.transform(out.output.message.content, lambda p: p.text))
    generic = F.coalesce(
        *[labels.blank_to_null(out[c]) for c in ("completion", "generated_text", "text")]
    )
    text = (
        F.when(claude, claude_text)
        .when(nova, nova_text)
        .when(llama, out.generation)
        .when(deepseek, F.get(out.choices, F.lit(0)).message.content)
        .otherwise(generic)
    )
    read = (
        F.when(claude, tokens(usage.input_tokens))
        .when(nova, tokens(usage.inputTokens))
        .when(llama, tokens(out.prompt_token_count))
        .otherwise(tokens(usage.prompt_tokens, usage.input_tokens))
    )
    written = (
        F.when(claude, tokens(usage.output_tokens))
        .when(nova, tokens(usage.outputTokens))
        .when(llama, tokens(out.generation_token_count))
        .otherwise(tokens(usage.completion_tokens, usage.output_tokens))
    )
    return parsed.withColumns(
        {
            "custom_id": F.coalesce("__a.recordId", "__a.custom_id"),
            "text": F.coalesce(text, F.lit("")),
            "input_tokens": read,
            "output_tokens": written,
            "error": error_text(F.col("__a.error")),
        }
    ).drop("__a")


def generate_answers(lines: DataFrame, line: str = "value") -> DataFrame:
    """Generate-content lines, known by the md5 of the prompt they echo."""
    parsed = lines.withColumn("__a", F.from_json(line, schemas.GENERATE_LINE))
    response = F.col("__a.response")
    users = F.filter("__a.request.contents", lambda c: c.role == "user")
    echoed = F.flatten(F.transform(users, lambda c: F.transform(c.parts, lambda p: p.text)))
    first = F.get(F.filter(echoed, lambda t: t != ""), F.lit(0))
    raw = _joined(F.transform(F.get(response.candidates, F.lit(0)).content.parts, lambda p: p.text))
    no_answer = F.when(response.isNull(), F.lit("No response from the service"))
    return parsed.withColumns(
        {
            "prompt_hash": F.md5(first),
            "text": codetext.structured_code(F.coalesce(raw, F.lit(""))),
            "input_tokens": tokens(response.usageMetadata.promptTokenCount),
            "output_tokens": tokens(response.usageMetadata.candidatesTokenCount),
            "error": F.coalesce(labels.blank_to_null(F.col("__a.status")), no_answer),
        }
    ).drop("__a")


def message_answers(lines: DataFrame, line: str = "value") -> DataFrame:
    """Message-batch lines: the code tool's input, else the first text block."""
    parsed = lines.withColumn("__a", F.from_json(line, schemas.MESSAGE_LINE))
    result = F.col("__a.result")
    content, usage = result.message.content, result.message.usage
    calls = F.filter(content, lambda b: (b.type == "tool_use") & (b["name"] == CODE_TOOL))
    said = F.filter(content, lambda b: b.type == "text")
    text = F.when(F.size(calls) > 0, F.get(calls, F.lit(0)).input.code).otherwise(
        F.get(said, F.lit(0)).text
    )
    failed = result.type.isin("errored", "canceled", "expired")
    return parsed.withColumns(
        {
            "custom_id": F.col("__a.custom_id"),
            "text": F.when(failed, F.lit("")).otherwise(F.coalesce(text, F.lit(""))),
            "input_tokens": tokens(usage.input_tokens),
            "output_tokens": tokens(usage.output_tokens),
            "error": F.when(failed, F.coalesce(error_text(result.error), result.type)),
        }
    ).drop("__a")


def priced(rows: DataFrame, pricing: DataFrame | None = None) -> DataFrame:
    """``cost`` from token counts; the built-in price list has eight fixed rows, so it is broadcast."""
    if pricing is None:
        listed = [(m, i, o) for m, (i, o) in PRICING.items()]
        schema = "model_id string, price_in double, price_out double"
        pricing = F.broadcast(rows.sparkSession.createDataFrame(listed, schema))
    p_in = F.coalesce("price_in", F.lit(DEFAULT_PRICE[0]))
    p_out = F.coalesce("price_out", F.lit(DEFAULT_PRICE[1]))
    cost = (F.col("input_tokens") * p_in + F.col("output_tokens") * p_out) / 1000
    return rows.join(pricing, "model_id", "left").withColumn("cost", cost).drop("price_in", "price_out")


def classify(answers: DataFrame, extracted: bool = True) -> DataFrame:
    """One ladder for all shapes: status, gen_status, code, error and token counts.

    With ``extracted`` off the text is the code itself, as tool calls deliver it.
    """
    text = F.col("text")
    code = codetext.extract_code(text) if extracted else text
    rows = answers.withColumn("code", F.when(F.col("error").isNull(), codetext.let(code, labels.blank_to_null)))
    rows = rows.withColumn("__valid", codetext.is_valid_python(F.col("code")))
    failed = F.col("error").isNotNull()
    empty = F.coalesce(text, F.lit("")) == ""
    no_code = F.col("code").isNull()
    invalid = ~F.col("__valid")

    def ladder(error, empty_, no_code_, invalid_, success) -> Column:
        return (
            F.when(failed, error).when(empty, empty_).when(no_code, no_code_).when(invalid, invalid_)
            .otherwise(success)
        )

    lost, none = F.lit("Generation Failed"), F.lit(None).cast("string")
    zero = {
        c: F.when(failed, F.lit(0)).otherwise(F.col(c))
        for c in ("input_tokens", "output_tokens", "cost")
        if c in answers.columns
    }
    return rows.withColumns(
        {
            "status": ladder(
                lost, lost, F.lit("Extraction Failed"), F.lit("Syntax Error"), F.lit("Success")
            ),
            "gen_status": F.when(failed | empty, F.lit("Error")).otherwise(F.lit("Success")),
            "error": ladder(
                F.col("error"),
                F.lit("Empty batch response"),
                F.lit("Failed to extract code from batch response"),
                F.lit("Invalid Python syntax"),
                none,
            ),
            "raw_response": F.when(~failed, text),
            "latency_ms": F.lit(0.0),
            **zero,
        }
    ).drop("__valid")


def resolve(outputs: DataFrame, errors: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per custom_id: output rows beat error rows, later rows beat earlier ones."""
    both = errors.withColumn("__rank", F.lit(0)).unionByName(outputs.withColumn("__rank", F.lit(1)))
    newest = [F.desc("__rank"), *[F.desc(c) for c in order]]
    return first_per_key(both.where(F.col("custom_id").isNotNull()), ["custom_id"], newest).drop("__rank")


def match_by_hash(
    answers: DataFrame, manifest: DataFrame, order: str, position: str, job: Sequence[str] = ("model_id",)
) -> DataFrame:
    """Answers with the custom_id of the request they echo; null where no request matches.

    A request is known by its job, the columns ``job`` of both sides, and its prompt: models that are asked
    the same keep their own answers. Within a job, of equal prompts the last request counts, and of its
    answers the last: both sides are reduced to one row per key before they meet, so copies of one prompt
    cannot multiply. ``answers_of_hash`` and ``requests_of_hash`` tell how many there were. All columns of the
    answers are sorted with them, so drop raw lines that are not needed any more.
    """
    key = [*job, "prompt_hash"]

    def last(df: DataFrame, by: str, count: str) -> DataFrame:
        rest = F.struct(*[c for c in df.columns if c not in key])
        newest = F.max_by(rest, F.struct(by)).alias("__last")
        held = df.groupBy(*key).agg(newest, F.count(F.lit(1)).alias(count))
        return held.select(*[F.col(c) if c in key else F.col(f"__last.{c}").alias(c) for c in df.columns], count)

    # Prompts stay behind: only the id of a request is wanted.
    asked = manifest.select(*dict.fromkeys([*key, "custom_id", position]))
    keyed = last(asked, position, "requests_of_hash").select(*key, "custom_id", "requests_of_hash")
    return last(answers, order, "answers_of_hash").join(keyed, key, "left")


def complete(manifest: DataFrame, generations: DataFrame, missing: str = "Missing batch result") -> DataFrame:
    """Every request of the manifest; those without an answer become failed generations."""
    defaults = {
        "status": "Generation Failed",
        "gen_status": "Error",
        "error": missing,
        "input_tokens": 0,
        "output_tokens": 0,
        "latency_ms": 0.0,
        "cost": 0.0,
    }
    found = generations.withColumn("__found", F.lit(True))
    joined = manifest.join(found, "custom_id", "left")
    lost = F.col("__found").isNull()
    return joined.withColumns(
        {
            c: F.when(lost, F.lit(v)).otherwise(F.col(c))
            for c, v in defaults.items()
            if c in generations.columns
        }
    ).drop("__found")


def failed_requests(requests: DataFrame, errors: DataFrame) -> DataFrame:
    """Requests to send again, and failed ids that no request has (``found`` false)."""
    failed = errors.select("custom_id").where(F.col("custom_id").isNotNull()).distinct()
    again = requests.join(failed, "custom_id", "left_semi").withColumn("found", F.lit(True))
    unknown = failed.join(requests, "custom_id", "left_anti").withColumn("found", F.lit(False))
    return again.unionByName(unknown, allowMissingColumns=True)


def merge_retry(original: DataFrame, retry: DataFrame) -> DataFrame:
    """Successful retries replace or add outputs; failed ones leave the original as it was.

    Both inputs have one row per custom_id with ``error`` null on success.
    """
    payload = [c for c in original.columns if c != "custom_id"]
    good = retry.where(F.col("error").isNull())
    new = good.select("custom_id", F.struct(*payload).alias("__new"))
    old = original.select("custom_id", F.struct(*payload).alias("__old"))
    picked = old.join(new, "custom_id", "full").withColumn("__row", F.coalesce("__new", "__old"))
    return picked.select("custom_id", "__row.*", F.col("__new").isNotNull().alias("replaced"))


def remaining_errors(errors: DataFrame, retry: DataFrame) -> DataFrame:
    """The new error set: errors not retried, and errors whose retry failed too (the retry's text)."""
    tried = retry.select("custom_id", F.col("error").alias("__again"))
    joined = errors.join(tried.withColumn("__tried", F.lit(True)), "custom_id", "left")
    kept = joined.where(F.col("__tried").isNull() | F.col("__again").isNotNull())
    return kept.withColumn("error", F.coalesce("__again", "error")).drop("__again", "__tried")


def join_manifest(manifest: DataFrame, generations: DataFrame) -> DataFrame:
    """Manifest with its generations; a request that has none fails the job."""
    found = generations.withColumn("__found", F.lit(True))
    joined = manifest.join(found, "custom_id", "left")
    problem = F.raise_error(F.concat(F.lit("no generation for "), F.col("custom_id")))
    checked = F.when(F.col("__found").isNull(), problem.cast("string")).otherwise(F.col("custom_id"))
    return joined.withColumn("custom_id", checked).drop("__found")


def assemble_items(joined: DataFrame, by: Sequence[str], attempt: Sequence[str], size: int = 1000) -> DataFrame:
    """Both prompts' attempts of each problem in trial order, in rows of at most ``size`` attempts a prompt.

    ``chunk`` numbers a problem's rows from 0; the attempts of a prompt fill one after the other. So a problem with
    any number of attempts is in no single array, and no task has all of them. An attempt without a trial index
    comes first.
    """
    order = [F.col("trial_index"), *[F.col(c) for c in attempt]]
    side = (F.col("prompt_type") == "detailed").alias("__detailed")
    rows = joined.select(*by, side, "trial_index", *attempt)
    placed = positions(rows, [*by, "__detailed"], order, "__at")
    placed = placed.withColumn("chunk", F.floor((F.col("__at") - 1) / size))
    row = F.struct("__at", F.struct("trial_index", *attempt).alias("attempt"))

    def arrays(is_detailed: bool) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("__detailed") == F.lit(is_detailed), row)))
        return F.transform(held, lambda x: x["attempt"])

    return placed.groupBy(*by, "chunk").agg(arrays(True).alias("with_prompt"), arrays(False).alias("without_prompt"))


def flatten_items(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """The attempts of assembled items again: by, prompt_type, trial_index and the attempt's fields."""

    def side(column: str, prompt: str) -> DataFrame:
        rows = items.select(*by, F.lit(prompt).alias("prompt_type"), F.explode(column).alias("__a"))
        return rows.select(*by, "prompt_type", "__a.*")

    return side("with_prompt", "detailed").unionByName(side("without_prompt", "minimal"))


def verdicts(raw: DataFrame) -> DataFrame:
    """The judge's raw answer as a verdict; needs state, submission_id, has_result and its fields."""
    success = F.col("has_result") & (F.col("state") == "SUCCESS")
    failure = F.col("has_result") & (F.col("state") == "FAILURE")
    status = (
        F.when(F.col("submission_id").isNull(), F.lit("Submission Failed"))
        .when(~F.col("has_result"), F.lit("Submission Result Missing"))
        .when(success, F.coalesce("status_msg", F.lit("Unknown")))
        .when(failure, F.lit("Error"))
        .otherwise(F.lit("Timeout"))
    )

    def on_success(col: str, default: str | None = None) -> Column:
        value = F.col(col) if default is None else F.coalesce(F.col(col), F.lit(default))
        return F.when(F.col("submission_id").isNotNull() & success, value)

    return raw.withColumns(
        {
            "status": status,
            "runtime": on_success("status_runtime", "0"),
            "memory": on_success("status_memory", "0"),
            "error": F.when(
                F.col("submission_id").isNotNull() & failure,
                F.coalesce("status_msg", F.lit("Unknown error")),
            ),
            **{
                c: on_success(c)
                for c in ("runtime_percentile", "memory_percentile", "total_correct", "total_testcases")
            },
            **{
                c: on_success(c, "")
                for c in ("code_output", "compile_error", "runtime_error", "full_runtime_error")
            },
        }
    ).drop("status_msg", "status_runtime", "status_memory", "state", "has_result")
