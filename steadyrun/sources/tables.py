"""The benchmark tables seen as evaluation data.

Each view is one SQL text that Spark and DuckDB read alike. Every view covers its whole tables: all
line items are log lines of attempts, all orders are experiment summaries, all documents are answers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# Problems: one per part. The label spellings are uneven on purpose.
VIEWS["v_problems"] = """
select cast(p_partkey as string) as frontend_question_id,
       cast(p_partkey + 1000 as string) as backend_question_id,
       p_name as title,
       concat(replace(p_name, ' ', '-'), '-', cast(p_partkey as string)) as title_slug,
       case when p_size <= 16 then 'Easy' when p_size <= 33 then ' medium' else 'HARD' end as difficulty,
       concat(replace(p_name, ' ', ', '), ', ', p_type) as topics,
       concat(p_name, ' ', p_brand) as description,
       concat('class Solution:', chr(10), '    def solve(self):') as code_template,
       (p_size = 7) as paid_only,
       p_partkey as seq
from part
"""

# The attempt log: an order is one (problem, model, prompt) cell and a line number one attempt of it.
# The same attempt can stand in the log more than once, as after a resumed run.
VIEWS["v_trial_log"] = """
select concat('model-', cast(model_no as string)) as model_name,
       cast(problem_no as string) as problem_id,
       case when l_returnflag = 'N' then ''
            when prompt_no = 0 then (case when l_returnflag = 'A' then 'with_prompt' else 'detailed' end)
            else (case when l_returnflag = 'A' then 'without_prompt' else 'minimal' end) end as strategy,
       case when prompt_no = 0 then 'with_prompt' else 'minimal' end as prompt_type,
       l_linenumber - 1 as trial_index,
       case when h < 2 + model_no % 4 then 'Accepted'
            when h < 5 + floor(model_no / 4) and l_returnflag <> 'R' then 'Accepted'
            when l_linestatus = 'O' and l_quantity > 45 then 'Submission Failed'
            when l_quantity > 30 then 'Time Limit Exceeded'
            when l_quantity > 20 then 'Runtime Error'
            else 'Wrong Answer' end as status,
       case when l_tax = 0.0 then 0.0 when l_discount = 0.1 then null else l_extendedprice end as latency_ms,
       case when l_discount = 0.0 then null else cast(l_quantity * 100 as bigint) end as input_tokens,
       case when l_tax = 0.01 then null else cast(floor(l_extendedprice / 10) as bigint) end as output_tokens,
       l_quantity / 1000.0 as cost,
       cast(l_discount * 1000 as double) as runtime_percentile,
       case when l_tax = 0.08 then null else cast(l_tax * 1250 as double) end as memory_percentile,
       case when l_linestatus = 'O' and l_quantity > 45 then null
            else l_orderkey * 10 + l_linenumber end as submission_id,
       l_shipdate as logged_at, l_extendedprice as tie_1, l_partkey as tie_2, l_suppkey as tie_3,
       l_quantity as tie_4, l_discount as tie_5, l_tax as tie_6, l_returnflag as tie_7
from (
  select l.*, l_orderkey % 16 as model_no,
         cast(floor(l_orderkey / 16) as bigint) % 2 as prompt_no,
         cast(floor(l_orderkey / 32) as bigint) as problem_no,
         (cast(floor(l_orderkey / 32) as bigint) * 7 + l_orderkey % 16 * 13
          + cast(floor(l_orderkey / 16) as bigint) % 2) % 10 as h
  from lineitem l) t
"""

# One row per experiment summary.
VIEWS["v_summaries"] = """
select o_orderkey as seq,
       concat(replace(cast(cast(o_orderdate as date) as string), '-', ''), '_',
              lpad(cast(o_orderkey % 86400 as string), 6, '0'), '_exp') as experiment_name,
       concat('model-', cast(o_custkey % 16 as string)) as model_name,
       case o_orderstatus when 'O' then 'detailed' when 'F' then 'minimal' else 'standard' end as prompt_type,
       case when o_orderkey % 3 = 0 then 'test' else 'main' end as dataset,
       case when o_orderkey % 7 = 0 then null else o_orderkey % 4 * 10 end as num_problems,
       case when o_orderkey % 11 = 0 then null else o_custkey % 6 end as stability_runs,
       case o_orderpriority when '1-URGENT' then 'realtime' when '2-HIGH' then 'qwen_batch'
            when '3-MEDIUM' then 'openai_batch' when '5-LOW' then 'replay' else null end as generation_mode,
       cast(0.3 + o_custkey % 2 * 0.4 as double) as temperature,
       cast(case when o_custkey % 5 = 0 then null else 0.9 end as double) as top_p,
       4096 as max_tokens,
       round(o_totalprice / 5000.0, 2) as run_level_pass_rate,
       round(o_totalprice / 6250.0, 2) as perfect_stability_rate,
       round(o_totalprice / 5500.0, 2) as first_pass_accuracy
from orders
"""

# A document is one request of a batch run; its number gives the problem, prompt and trial.
_MODEL = """case lang when 'en' then 'qwen-plus' when 'fr' then 'gpt-4o' when 'de' then 'gemini-1.5-pro'
                 else 'other-model' end"""
_REQUEST = f"""select d.*, {_MODEL} as model_id, cast(floor(doc_id / 10) as bigint) as problem_no,
         case when cast(floor(doc_id / 5) as bigint) % 2 = 0 then 'detailed' else 'minimal' end as prompt_type,
         doc_id % 5 as trial_index
  from documents d"""
_CUSTOM_ID = """concat('model=', model_id, '|problem=', cast(problem_no as string), '|slug=p-',
              cast(problem_no as string), '|prompt=', prompt_type, '|trial=', cast(trial_index as string))"""

# One row per request, the whole document being the prompt.
VIEWS["v_manifest"] = f"""
select {_CUSTOM_ID} as custom_id,
       doc_id, model_id, cast(problem_no as string) as problem_id,
       concat('p-', cast(problem_no as string)) as title_slug, prompt_type, trial_index, text as prompt,
       md5(concat(text, chr(10), '<!-- trial=', cast(trial_index as string), ' -->')) as prompt_hash
from ({_REQUEST}) r
"""

# The answers: each document has a kind of answer, holding its whole text; documents labelled low
# quality were never answered.
VIEWS["v_answers"] = f"""
select {_CUSTOM_ID} as custom_id, doc_id, model_id, problem_no, prompt_type, trial_index, lang,
       doc_id % 8 as variant, text,
       case doc_id % 8
         when 0 then concat('Answer:', chr(10), '```python', chr(10), 'class Solution:', chr(10),
                            '    def f(self):', chr(10), '        return 1', chr(10), '```', chr(10), text)
         when 1 then concat('<think>', text, '</think>', chr(10), 'class Solution:', chr(10), '    x = 1')
         when 2 then text
         when 3 then ''
         when 4 then concat('```python', chr(10), 'class Solution', chr(10), '    x = 1', chr(10), '```', chr(10), text)
         when 5 then concat('import os', chr(10), 'print(1)', chr(10), '# ',
                            replace(text, chr(10), concat(chr(10), '# ')))
         when 7 then concat(text, chr(10), '```', chr(10), 'x = 2', chr(10), '```')
         else null end as response_text,
       case when doc_id % 8 = 6 then 'rate_limited' else null end as error,
       n_chars as input_tokens, n_chars % 977 as output_tokens
from ({_REQUEST}) r
left join (select doc_id as low_id from labels where quality = 0 group by doc_id) l on r.doc_id = l.low_id
where l.low_id is null
"""

VIEWS["v_submissions"] = """
select event_id, ts, user_id % 10 as account,
       case when event_type in ('error', 'signup') then 'Submission Failed' else 'Accepted' end as status,
       case when event_type in ('error', 'signup') then null else event_id end as submission_id,
       (event_type <> 'view') as has_code
from events
"""

VIEWS["v_job_state"] = """
select concat('model-', cast(user_id % 16 as string)) as model_id,
       case when user_id % 2 = 0 then 'detailed' else 'minimal' end as prompt_type,
       event_id, ts,
       case event_type when 'signup' then 'pending' when 'click' then 'in_progress'
            when 'error' then 'failed' else 'completed' end as status,
       (value > 5) as normalized_exists
from events
"""


def _names(sql: str, known) -> list[str]:
    return [n for n in known if re.search(rf"\b{n}\b", sql)]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; its schema is taken from the files once, not by a job per query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A file stream takes a directory or a pattern; the pattern also fits a table of one file.
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def view(spark: SparkSession, sf_dir: str, name: str, streams: Sequence[str] = ()) -> DataFrame:
    """One of ``VIEWS`` over the tables in ``sf_dir``, those in ``streams`` read as streams."""
    sql = VIEWS[name]
    used = _names(sql, TABLES)
    for t in used:
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    frames = {t: (table_stream if t in streams else table)(spark, sf_dir, t) for t in used}
    return spark.sql(sql, **frames)
