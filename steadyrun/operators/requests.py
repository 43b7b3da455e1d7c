"""Building generation requests: the grid, ids, prompts and bodies."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steadyrun.functions.labels import sanitize

# What the model is told about its role; callers pass their own to reproduce a study.
SYSTEM = "Work as a careful Python developer: choose a correct and fast algorithm, then write it out in full."

# Prompt templates with the two placeholders. Callers pass their own to reproduce a study.
TEMPLATES = {
    "detailed": (
        "Solve the problem below in Python 3.\n"
        "Read the constraints, pick an algorithm that meets them, and handle edge cases.\n"
        "Keep the given signature and return only source code.\n\n"
        "<problem>\n{problem_description}\n</problem>\n\n"
        "<code_template>\n{code_template}\n</code_template>\n"
    ),
    "minimal": (
        "Solve the problem below in Python 3. Return only source code.\n\n"
        "<problem>\n{problem_description}\n</problem>\n\n"
        "<code_template>\n{code_template}\n</code_template>\n"
    ),
}

# Names and markers of the providers' formats, and the tool through which a tool-calling model
# hands in its code.
CODE_TOOL = "submit_solution"
CHAT_URL = "/v1/chat/completions"
CLAUDE_VERSION, NOVA_VERSION = "bedrock-2023-05-31", "messages-v1"
LLAMA_SYSTEM = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n"
LLAMA_USER = "<|eot_id|><|start_header_id|>user<|end_header_id|>\n"
LLAMA_END = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"
MIN_STRUCTURED_BUDGET = 16384

# What the tool and its one field are said to be.
TOOL_TEXT = "Hands in the finished Python program."
CODE_TEXT = "The whole program, without any words around it."


def expand_requests(
    problems: DataFrame, models: Sequence[str], prompts: Sequence[str], runs: int
) -> DataFrame:
    """One row per (trial, problem, model, prompt). Rows multiply in place; nothing is joined.

    Problems are few bytes and thus few splits for all the requests made of them, so their rows are first dealt to
    as many tasks as a shuffle has.
    """
    tasks = int(problems.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(values: Sequence[str]) -> Column:
        return F.explode(F.array(*[F.lit(v) for v in values]))

    return (
        problems.repartition(tasks)
        .withColumn("model_id", each(models))
        .withColumn("prompt_type", each(prompts))
        .withColumn("trial_index", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    )


def custom_id(model: Column, problem: Column, slug: Column, prompt: Column, trial: Column) -> Column:
    parts = [("model", model), ("problem", problem), ("slug", slug), ("prompt", prompt)]
    named = [F.concat(F.lit(f"{name}="), sanitize(c)) for name, c in parts]
    return F.concat_ws("|", *named, F.concat(F.lit("trial="), trial.cast("string")))


def hashed_custom_id(full: Column) -> Column:
    """For services that take at most 64 characters."""
    return F.sha1(full)


def parse_custom_id(ident: Column) -> Column:
    """The parts of a custom id as a map."""
    return F.str_to_map(ident, F.lit("\\|"), F.lit("="))


def render_prompt(template: str, description: Column, code_template: Column) -> Column:
    """The template with both placeholders filled; values are never scanned for placeholders."""
    values = {"problem_description": description, "code_template": code_template}
    parts: list[Column] = []
    for text, field, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(F.coalesce(values[field], F.lit("None")))
    return F.concat(*parts)


def render_by_type(prompt_type: Column, description: Column, code_template: Column,
                   templates: dict[str, str] = TEMPLATES) -> Column:
    """The detailed template for ``detailed``, the minimal one for anything else."""
    detailed, minimal = (
        render_prompt(templates[k], description, code_template) for k in ("detailed", "minimal")
    )
    return F.when(prompt_type == "detailed", detailed).otherwise(minimal)


def tagged_prompt(prompt: Column, trial: Column) -> Column:
    """Prompt with a hidden trial mark, so that repeated trials hash differently."""
    return F.concat(prompt, F.lit("\n<!-- trial="), trial.cast("string"), F.lit(" -->"))


def prompt_hash(prompt: Column, trial: Column) -> Column:
    return F.md5(tagged_prompt(prompt, trial))


def thinking_config(model: Column, tokens: Column) -> Column:
    """JSON text of the thinking settings: a level for 3.x, a budget for 2.5, null for others."""
    name = F.lower(model)
    budget = F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0))
    level = F.when(budget > 0, F.lit("HIGH")).otherwise(F.lit("LOW"))
    return F.when(
        F.startswith(name, F.lit("gemini-3")), F.to_json(F.struct(level.alias("thinkingLevel")))
    ).when(
        F.startswith(name, F.lit("gemini-2.5")), F.to_json(F.struct(budget.alias("thinkingBudget")))
    )


def shape_of(model: Column) -> Column:
    """Request shape of a model served by its own family's interface."""
    low = F.lower(model)
    return (
        F.when(F.contains(model, F.lit("anthropic.claude")), F.lit("claude"))
        .when(F.contains(model, F.lit("amazon.nova")), F.lit("nova"))
        .when(F.contains(model, F.lit("meta.llama")), F.lit("llama"))
        .when(F.startswith(low, F.lit("gemini")), F.lit("generate"))
        .when(F.startswith(low, F.lit("claude")), F.lit("tool"))
        .when(model.rlike(r"^o\d"), F.lit("chat_reasoning"))
        .when(F.contains(low, F.lit("deepseek.")), F.lit("deepseek"))
        .when(F.contains(model, F.lit(":")), F.lit("generic"))
        .otherwise(F.lit("chat"))
    )


def _messages(prompt: Column, system: str | None = None) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = message("user", prompt)
    return F.array(message("system", F.lit(system)), user) if system is not None else F.array(user)


def request_bodies(
    model: Column,
    prompt: Column,
    temperature: Column,
    top_p: Column,
    max_tokens: Column,
    thinking_tokens: Column,
    system: str = SYSTEM,
) -> dict[str, Column]:
    """The request body of each shape as a struct."""
    text = F.struct(prompt.alias("text"))
    sampling = [temperature.alias("temperature"), top_p.alias("top_p")]
    limit = max_tokens.alias("max_tokens")
    budget = F.greatest(max_tokens, F.lit(MIN_STRUCTURED_BUDGET)) + F.coalesce(thinking_tokens, F.lit(0))
    code_field = F.struct(F.lit("string").alias("type"), F.lit(CODE_TEXT).alias("description"))
    code_object = F.struct(
        F.lit("object").alias("type"), F.struct(code_field.alias("code")).alias("properties"),
        F.array(F.lit("code")).alias("required"),
    )
    thinking = F.from_json(
        thinking_config(model, thinking_tokens), "thinkingLevel string, thinkingBudget int"
    )
    return {
        "chat": F.struct(
            model.alias("model"), _messages(prompt, system).alias("messages"), *sampling, limit
        ),
        "chat_reasoning": F.struct(
            model.alias("model"), _messages(prompt, system).alias("messages"),
            max_tokens.alias("max_completion_tokens"),
        ),
        "claude": F.struct(
            F.lit(CLAUDE_VERSION).alias("anthropic_version"), limit,
            F.lit(system).alias("system"), _messages(prompt).alias("messages"), *sampling,
        ),
        "nova": F.struct(
            F.lit(NOVA_VERSION).alias("schemaVersion"),
            F.array(F.struct(F.lit("user").alias("role"), F.array(text).alias("content"))).alias("messages"),
            F.array(F.struct(F.lit(system).alias("text"))).alias("system"),
            F.struct(max_tokens.alias("max_new_tokens"), *sampling).alias("inferenceConfig"),
        ),
        "llama": F.struct(
            F.concat(F.lit(LLAMA_SYSTEM + system + LLAMA_USER), prompt, F.lit(LLAMA_END)).alias("prompt"),
            max_tokens.alias("max_gen_len"), *sampling,
        ),
        "deepseek": F.struct(_messages(prompt, system).alias("messages"), limit, *sampling),
        "generic": F.struct(F.concat(F.lit(system + "\n\n"), prompt).alias("prompt"), limit, *sampling),
        "generate": F.struct(
            F.array(F.struct(F.lit("user").alias("role"), F.array(text).alias("parts"))).alias("contents"),
            F.struct(F.array(F.struct(F.lit(system).alias("text"))).alias("parts")).alias("systemInstruction"),
            F.struct(
                temperature.alias("temperature"), budget.alias("maxOutputTokens"), top_p.alias("topP"),
                F.lit("application/json").alias("responseMimeType"),
                code_object.alias("responseSchema"), thinking.alias("thinkingConfig"),
            ).alias("generationConfig"),
        ),
        "tool": F.struct(
            model.alias("model"), limit, temperature.alias("temperature"),
            F.lit(system).alias("system"), _messages(prompt).alias("messages"),
            F.array(
                F.struct(
                    F.lit(CODE_TOOL).alias("name"), F.lit(TOOL_TEXT).alias("description"),
                    code_object.alias("input_schema"),
                )
            ).alias("tools"),
            F.struct(F.lit("tool").alias("type"), F.lit(CODE_TOOL).alias("name")).alias("tool_choice"),
        ),
    }


def request_body(shape: Column, **parts: Column | str) -> Column:
    """JSON text of the body in the shape named by ``shape``; absent fields are left out."""
    out = None
    for name, body in request_bodies(**parts).items():
        text = F.to_json(body, {"writeNonAsciiCharacterAsCodePoint": "true"})
        out = F.when(shape == name, text) if out is None else out.when(shape == name, text)
    return out


def request_envelope(shape: Column, custom_id: Column, body: Column) -> Column:
    """The line of a request file around the JSON text ``body``, as the service that takes ``shape`` reads it.

    The line of the generate service has no id; its answers are matched by prompt.
    """
    ident = F.regexp_extract(
        F.to_json(F.struct(custom_id.alias("v")), {"writeNonAsciiCharacterAsCodePoint": "true"}), r'^\{"v":(.*)\}$', 1
    )
    chat = F.concat(
        F.lit('{"custom_id":'), ident, F.lit(f',"method":"POST","url":"{CHAT_URL}","body":'), body, F.lit("}")
    )
    return (
        F.when(shape == "generate", F.concat(F.lit('{"request":'), body, F.lit("}")))
        .when(shape == "tool", F.concat(F.lit('{"custom_id":'), ident, F.lit(',"params":'), body, F.lit("}")))
        .when(shape.isin("chat", "chat_reasoning"), chat)
        .otherwise(F.concat(F.lit('{"recordId":'), ident, F.lit(',"modelInput":'), body, F.lit("}")))
    )


def manifest_rows(requests: DataFrame) -> DataFrame:
    """One manifest row per request of a grid with its problem's columns, custom_id, shape, prompt and body.

    The hash that answers without an id are matched by is there for the shape that needs it.
    """
    known = set(requests.columns)

    def first(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in known]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    topics = F.col("topics") if "topics" in known else F.array().cast("array<string>")
    return requests.select(
        "custom_id", "model_id",
        first("frontend_question_id", "problem_id", "question_id").alias("problem_id"),
        first("question_id", "backend_question_id").alias("backend_question_id"),
        *[first(c).alias(c) for c in ("title", "title_slug", "difficulty")],
        topics.alias("topics"), "prompt_type", F.col("trial_index").cast("int").alias("trial_index"),
        F.when(F.col("shape") != "generate", F.col("body")).alias("input_file_body"),
        F.when(F.col("shape") == "generate", prompt_hash(F.col("prompt"), F.col("trial_index"))).alias("prompt_hash"),
    )


def job_name(run_id: Column, model: Column, prompt: Column, max_len: int) -> Column:
    raw = F.concat_ws("-", sanitize(run_id), sanitize(model), prompt)
    return F.rtrim(F.substring(F.regexp_replace(raw, "[^A-Za-z0-9-]+", "-"), 1, max_len), F.lit("-"))


def pending_requests(requests: DataFrame, jobs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Requests of a (model, prompt) that has no job yet."""
    return requests.join(jobs.select(*key).distinct(), list(key), "left_anti")
