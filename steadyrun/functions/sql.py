"""SQL functions for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LABEL = "coalesce(nullif(strategy, ''), nullif(prompt_type, ''), 'default')"
_CLEAN = "regexp_replace({}, '[^A-Za-z0-9._-]+', '_')"
_SPREAD = "1.96D * sqrt((s / n * (1 - s / n) + 3.8416D / (4 * n)) / n)"

FUNCTIONS = [
    f"""normalize_strategy(strategy STRING, prompt_type STRING) RETURNS STRING
RETURN CASE {_LABEL} WHEN 'with_prompt' THEN 'detailed' WHEN 'without_prompt' THEN 'minimal' ELSE {_LABEL} END""",
    f"""wilson(s DOUBLE, n DOUBLE) RETURNS STRUCT<lo: DOUBLE, hi: DOUBLE>
RETURN CASE WHEN coalesce(n, 0D) = 0D THEN named_struct('lo', 0D, 'hi', 0D) ELSE named_struct(
  'lo', greatest(0D, (s / n + 3.8416D / (2 * n) - {_SPREAD}) / (1 + 3.8416D / n)) * 100,
  'hi', least(1D, (s / n + 3.8416D / (2 * n) + {_SPREAD}) / (1 + 3.8416D / n)) * 100) END""",
    f"""custom_id(model STRING, problem STRING, slug STRING, prompt STRING, trial BIGINT) RETURNS STRING
RETURN concat('model=', {_CLEAN.format("model")}, '|problem=', {_CLEAN.format("problem")}, '|slug=',
  {_CLEAN.format("slug")}, '|prompt=', {_CLEAN.format("prompt")}, '|trial=', cast(trial AS STRING))""",
]


def register(spark: SparkSession) -> None:
    """Make ``normalize_strategy``, ``wilson`` and ``custom_id`` known to this session."""
    for body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
