"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of documents; the last
gives the packed pieces. ``run`` writes every stage's result to the shared folder and reads it back, so a lost
executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from steadyrun.llm import decontaminate, near_dedup, ordinal, packing, surrogates
from steadyrun.sources.scratch import shared_dir, stored

LEAST_TAIL = 0.5
KEY = "corpus pipeline"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely the best; the classifier is fitted on rated ones among them.

    Null, empty and blank texts are graded by the thresholds alone; rows that repeat are graded alike; an empty
    table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = ordinal.scored(docs, ordinal.fit(docs, ratings), F.col("text"), "__scored")
    return rated.where(ordinal.accepted(F.col("__scored"), LEAST_TAIL)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 of five-word shingles: that with the smallest doc_id.

    Rows are told apart by a number of their own, so copies that repeat a doc_id or have none are copies too. Of
    several rows with the smallest doc_id, or where all are without, a hash of the row decides.
    """
    rows = stored(
        docs.select("*", F.monotonically_increasing_id().alias("__row"), F.xxhash64(*docs.columns).alias("__hash")), "rows"
    )
    marked = near_dedup.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), width=5, percent=80, bands=40)
    groups = marked.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__hash", "__row")
    known = rows.select("__row", "__hash", "doc_id").join(groups, "__row")
    firsts = known.groupBy("__group").agg(F.min(order).alias("__first"))
    kept = firsts.select(F.col("__first.__row").alias("__row")).hint("merge")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edits of a tenth allowed.

    Null, empty and blank texts hold none and stay; rows that repeat share their fate.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.with_found_items(docs, items, "text", "__found")
    return found.where(F.size("__found") == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars is that of the new text."""
    return surrogates.surrogated(docs, KEY).withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids.

    A null text is an empty one, whose piece is the end id; rows that repeat are packed each.
    """
    return packing.pack(docs, TOKENIZER, capacity=2048, added_tokens=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", clean_of_benchmarks),
    ("personal data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fitting, grouping by hashes and tokenizing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None
QUERIES = {"pipeline": (run, ORACLE_SQL)}
