"""Explicit schemas. Nothing is inferred."""

from __future__ import annotations

TRIAL = """
problem_id string, backend_question_id string, problem string, strategy string, prompt_type string,
trial_index int, provider string, model_name string, temperature double, top_p double, max_tokens int,
verdict string, status string, accepted_bool int, prompt_tokens bigint, completion_tokens bigint,
input_tokens bigint, output_tokens bigint, latency_ms double, cost double, gen_status string,
error string, raw_response string, code string, submission_id string, runtime string, memory string,
runtime_percentile double, memory_percentile double, total_correct bigint, total_testcases bigint,
code_output string, compile_error string, runtime_error string, full_runtime_error string
"""

ATTEMPT = """struct<
status:string, timestamp:string, prompt_type:string, gen_status:string, error:string, raw_response:string,
code:string, submission_id:string, runtime:string, memory:string, runtime_percentile:string,
memory_percentile:string, total_correct:string, total_testcases:string, latency_ms:string,
input_tokens:string, output_tokens:string, cost:string>"""

RESULTS = f"""
problem_id string, backend_question_id string, title string, title_slug string, difficulty string,
topics array<string>, timestamp string, with_prompt array<{ATTEMPT}>, without_prompt array<{ATTEMPT}>
"""

PROBLEM = """
question_id string, problem_id string, frontend_question_id string, backend_question_id string,
title string, title_slug string, difficulty string, description string, code_template string,
topics array<string>, sample_test string, hints array<string>, likes bigint, dislikes bigint,
isPaidOnly boolean
"""

SUMMARY = """
experiment_name string, model_name string, prompt_type string, provider string, temperature double,
top_p double, max_tokens int, dataset string, num_problems int, stability_runs int,
generation_mode string, total_problems bigint, total_runs bigint, run_level_pass_rate double,
run_level_ci_95 array<double>, perfect_stability_rate double, perfect_stability_ci_95 array<double>,
first_pass_accuracy double, first_pass_ci_95 array<double>, average_variance double,
average_variance_ci_95 array<double>, p50_latency_ms double, p90_latency_ms double,
`pass@1` double, `pass@3` double, `pass@5` double
"""

MANIFEST = """
custom_id string, model_id string, problem_id string, backend_question_id string, title string,
title_slug string, difficulty string, topics array<string>, prompt_type string, trial_index int,
prompt_hash string
"""

# One batch answer line per provider shape. Fields whose type varies are variants.
CHAT_LINE = """
custom_id string, error variant,
response struct<body struct<error variant,
  choices array<struct<message struct<content variant>>>,
  usage struct<prompt_tokens string, completion_tokens string>>>
"""

MODEL_OUTPUT_LINE = """
recordId string, custom_id string, error variant,
modelOutput struct<
  content array<struct<type string, text string>>,
  output struct<message struct<content array<struct<text string>>>>,
  generation string,
  choices array<struct<message struct<content string>>>,
  completion string, generated_text string, text string,
  prompt_token_count string, generation_token_count string,
  usage struct<input_tokens string, output_tokens string, inputTokens string, outputTokens string,
               prompt_tokens string, completion_tokens string>>
"""

GENERATE_LINE = """
status string,
request struct<contents array<struct<role string, parts array<struct<text string>>>>>,
response struct<candidates array<struct<content struct<parts array<struct<text string>>>>>,
  usageMetadata struct<promptTokenCount string, candidatesTokenCount string>>
"""

MESSAGE_LINE = """
custom_id string,
result struct<type string, error variant,
  message struct<content array<struct<type string, name string, text string, input struct<code string>>>,
                 usage struct<input_tokens string, output_tokens string>>>
"""
