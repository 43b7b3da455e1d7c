"""Readers. Paths may be files, directories or globs; every reader is a distributed scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from steadyrun.functions import labels
from steadyrun.operators.stability import first_per_key
from steadyrun.sources import json_arrays, schemas

_KINDS = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType()}
_TRIAL = StructType([StructField(n, _KINDS[t]) for n, t in (part.split() for part in schemas.TRIAL.split(","))])


def _paths(paths: str | Sequence[str]) -> list[str]:
    """Each path once, in the order given."""
    return [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))


def _objects(lines: DataFrame) -> DataFrame:
    """Lines that are a JSON object, with the struct ``__raw`` of the trial fields as text.

    Every field is read as text, so a field of another JSON type costs that field at most, and which lines
    count does not depend on the columns that are asked for.
    """
    fields = StructType([StructField(f.name, StringType()) for f in _TRIAL.fields])
    broken = StructField("__broken", StringType())
    raw = F.from_json("value", StructType([*fields.fields, broken]), {"columnNameOfCorruptRecord": "__broken"})
    found = lines.where(F.startswith(F.trim("value"), F.lit("{"))).withColumn("__raw", raw)
    return found.where(F.col("__raw.__broken").isNull())


def _typed(field: StructField) -> Column:
    """A field as its type, null where its text is no such value. Flags and fractions are taken as numbers."""
    text = F.col(f"__raw.{field.name}")
    if isinstance(field.dataType, StringType):
        return text.alias(field.name)
    flag = F.when(F.lower(text) == "true", "1").when(F.lower(text) == "false", "0").otherwise(F.trim(text))
    number = flag.try_cast("double")
    number = F.when(~F.isnan(number), number)
    if isinstance(field.dataType, DoubleType):
        return number.alias(field.name)
    whole = F.coalesce(flag.try_cast("bigint"), F.round(number).try_cast("bigint"))
    return whole.try_cast(field.dataType).alias(field.name)


def _trials(lines: DataFrame, *more: Column) -> DataFrame:
    return _objects(lines).select(*map(_typed, _TRIAL.fields), *more)


def read_trials(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Trial JSONL; lines that are no JSON object are dropped, fields that don't fit their type are null."""
    return _trials(spark.read.text(_paths(paths)))


def read_trial_archive(
    spark: SparkSession, dirs: Sequence[str], pattern: str = "*.jsonl"
) -> DataFrame:
    """All files of ``pattern`` in several directories, labels normalised, verdict flag defaulting to 0.

    A bad line costs that line only, a bad field that field; ``bad_lines`` and ``bad_fields`` count them.
    """
    lines = spark.read.option("pathGlobFilter", pattern).text(_paths(dirs))
    rows = _trials(lines, F.input_file_name().alias("source_file"))
    return rows.withColumns(
        {
            "prompt_type": labels.normalize_strategy(F.col("strategy"), F.col("prompt_type")),
            "strategy": labels.normalize_strategy(F.col("strategy"), F.col("prompt_type")),
            "accepted_bool": F.coalesce("accepted_bool", F.lit(0)),
            "accepted": labels.accepted(F.col("status")),
        }
    )


def bad_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines per file that the readers above drop."""
    lines = spark.read.text(_paths(paths)).withColumn("source_file", F.input_file_name())
    every = lines.where(F.trim("value") != "").groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"))
    good = _objects(lines).groupBy("source_file").agg(F.count(F.lit(1)).alias("good"))
    counts = every.join(good, "source_file", "left")
    bad = (F.col("lines") - F.coalesce("good", F.lit(0))).alias("bad_lines")
    return counts.select("source_file", bad).where("bad_lines > 0")


def bad_fields(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """How often, per file and field, a value is there that doesn't fit the field's type."""
    rows = _objects(spark.read.text(_paths(paths)).withColumn("source_file", F.input_file_name()))
    numeric = [f for f in _TRIAL.fields if not isinstance(f.dataType, StringType)]
    lost = [F.when(F.col(f"__raw.{f.name}").isNotNull() & _typed(f).isNull(), F.lit(f.name)) for f in numeric]
    each = rows.select("source_file", F.explode(F.array_compact(F.array(*lost))).alias("field"))
    return each.groupBy("source_file", "field").agg(F.count(F.lit(1)).alias("values"))


def read_results(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Result files: a JSON array of problems with two arrays of attempts each. Large files are many tasks."""
    found = json_arrays.elements(spark, _paths(paths))
    return found.select(F.from_json("text", schemas.RESULTS).alias("r")).select("r.*")


def read_problems(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Problem files with ``seq``: the place of the path among ``paths``, the file, then the place in the file.

    Of a directory's files the names decide. Large files are many tasks. Feed to ``load_problems``.
    """
    found = json_arrays.elements(spark, _paths(paths))
    rows = found.select("seq", F.from_json("text", f"struct<{schemas.PROBLEM}>").alias("p"))
    return rows.select("p.*", "seq").withColumnRenamed("isPaidOnly", "paid_only")


def read_summaries(spark: SparkSession, dirs: str | Sequence[str], pattern: str = "*.json") -> DataFrame:
    """Summary files, of one JSON object or an array of them; intervals become ``struct<lo, hi>``. ``seq`` is the
    place of the path among ``dirs``, the file, and the place in the file."""
    found = json_arrays.elements(spark, _paths(dirs), pattern=pattern)
    rows = found.select("seq", F.from_json("text", f"struct<{schemas.SUMMARY}>").alias("s")).select("s.*", "seq")
    for name in ("run_level", "perfect_stability", "first_pass", "average_variance"):
        ci = F.col(f"{name}_ci_95")
        pair = F.struct(F.get(ci, F.lit(0)).alias("lo"), F.get(ci, F.lit(1)).alias("hi"))
        rows = rows.withColumn(f"{name}_ci_95", F.when(F.size(ci) == 2, pair))
    for k in (1, 3, 5):
        rows = rows.withColumnRenamed(f"pass@{k}", f"pass_at_{k}")
    return rows


def read_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Manifests as one JSON array per file. A file is one task; ``read_manifest_lines`` splits files."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(_paths(paths))


def read_manifest_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Manifests of one JSON object per line; files are split among tasks."""
    return spark.read.schema(schemas.MANIFEST).json(_paths(paths))


def valid_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines that parse as JSON."""
    return lines.where(F.try_parse_json(col).isNotNull())


def read_batch_outputs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw answer lines of all shards; blank and bad lines are dropped."""
    return valid_lines(spark.read.text(_paths(paths)))


def read_archives(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """Trial rows of several archives with the modification time of their file."""
    lines = spark.read.text(_paths(dirs)).select("value", "_metadata.file_modification_time")
    rows = _trials(lines, F.col("file_modification_time").alias("modified_at"))
    return rows.withColumn(
        "strategy", labels.normalize_strategy(F.col("strategy"), F.col("prompt_type"))
    )


def merge_archives(
    archives: Sequence[DataFrame], key: Sequence[str], newest: Sequence[Column]
) -> DataFrame:
    """Rows of all archives; where two hold the same key the newer one wins."""
    out = archives[0]
    for other in archives[1:]:
        out = out.unionByName(other)
    return first_per_key(out, key, newest)


def read_configs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Config files as (path, content)."""
    files = spark.read.format("binaryFile").load(_paths(paths))
    return files.select(
        F.regexp_replace("path", "^file:", "").alias("path"), F.col("content").cast("string").alias("content")
    )


def run_id(prefix: str, path: Column, content: Column, with_path: bool = False) -> Column:
    """``prefix_<safe file stem>_<10 hex of sha1>``: the same config always gets the same run."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}._-]", "_")
    hashed = F.concat(path, F.lit("\0"), content) if with_path else content
    return F.concat(F.lit(prefix + "_"), safe, F.lit("_"), F.substring(F.sha1(hashed), 1, 10))


def flatten_results(results: DataFrame) -> DataFrame:
    """One row per attempt of the nested results, in one pass over them."""
    numeric = [
        "runtime_percentile", "memory_percentile", "total_correct", "total_testcases", "latency_ms",
        "input_tokens", "output_tokens", "cost",
    ]

    def tagged(col: str) -> Column:
        kind = F.lit(col).alias("prompt_type")
        rows = F.transform(
            col, lambda a, i: F.struct(kind, i.alias("trial_index"), a.alias("attempt"))
        )
        return F.coalesce(rows, F.array())

    rows = results.select(
        "*", F.explode(F.concat(tagged("with_prompt"), tagged("without_prompt"))).alias("__row")
    )
    fields = set(rows.schema["__row"].dataType["attempt"].dataType.names)

    def attempt(name: str) -> Column:
        return F.col(f"__row.attempt.{name}") if name in fields else F.lit(None).cast("string")

    keys = [c for c in ("model_name",) if c in results.columns]
    return rows.select(
        *keys,
        "problem_id",
        "title",
        labels.clean_difficulty(F.col("difficulty")).alias("difficulty"),
        F.array_join("topics", ", ").alias("topics"),
        F.col("__row.prompt_type").alias("prompt_type"),
        labels.normalize_strategy(F.col("__row.prompt_type")).alias("strategy"),
        F.col("__row.trial_index").alias("trial_index"),
        attempt("status").alias("status"),
        attempt("runtime").alias("runtime"),
        attempt("memory").alias("memory"),
        attempt("submission_id").alias("submission_id"),
        *[labels.coerce_numeric(attempt(c).cast("string")).alias(c) for c in numeric],
    )
