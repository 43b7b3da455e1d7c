"""The problem table: loading, choosing, and joining it to attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steadyrun.functions import labels

# Display order of the tiers.
TIERS = {"Easy": 0, "Medium": 1, "Hard": 2, "Unknown": 3}


def load_problems(problems: DataFrame, difficulty: str | None = None, n: int | None = None) -> DataFrame:
    """Ids as strings with fallbacks, difficulty cleaned, filtered, and cut to the first n by ``seq``.

    A problem with no backend id cannot be judged, so it fails the job.
    """
    names = set(problems.columns)

    def first_of(*options: str):
        present = [labels.blank_to_null(F.col(c).cast("string")) for c in options if c in names]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    backend = first_of("backend_question_id", "question_id")
    message = F.concat(F.lit("problem without backend id: "), F.coalesce("title_slug", F.lit("?")))
    out = problems.withColumns(
        {
            "question_id": F.coalesce(backend, F.raise_error(message).cast("string")),
            "frontend_question_id": F.coalesce(first_of("frontend_question_id", "problem_id"), backend),
            "difficulty": labels.clean_difficulty("difficulty" if "difficulty" in names else F.lit(None)),
        }
    )
    if difficulty:
        out = out.where(F.upper("difficulty") == difficulty.upper())
    return out.orderBy("seq").limit(n) if n is not None else out


def select_problems(
    problems: DataFrame,
    difficulty: str | None = None,
    limit: int | None = None,
    offset: int | None = None,
    skip_premium: bool = False,
) -> DataFrame:
    """A slice of the problem list in the order of ``seq``, which tells problems apart."""
    out = problems
    if difficulty:
        out = out.where(F.upper(F.trim("difficulty")) == difficulty.upper())
    if skip_premium:
        out = out.where(~F.coalesce("paid_only", F.lit(False)))
    if offset:
        # The rows after the last of the first ``offset``: only those are brought together.
        skipped = out.select("seq").orderBy("seq").limit(offset).agg(F.max("seq")).scalar()
        out = out.where(F.col("seq") > skipped)
    out = out.orderBy("seq")
    return out if limit is None else out.limit(limit)


def latest_problems(problems: DataFrame, n: int, id_col: str = "frontend_question_id") -> DataFrame:
    """The n free problems with the largest all-digit ids."""
    digits = F.trim(F.col(id_col).cast("string"))
    return (
        problems.where(~F.coalesce("paid_only", F.lit(False)) & digits.rlike("^[0-9]+$"))
        .withColumn("frontend_id_num", digits.cast("bigint"))
        .orderBy(F.desc("frontend_id_num"))
        .limit(n)
    )


def sample_problems(
    problems: DataFrame, n: int, seed: int, id_col: str = "frontend_question_id", pool: int | None = None
) -> DataFrame:
    """A repeatable sample of n free problems, out of all of them or of the first ``pool`` problems."""
    rows = problems if pool is None else problems.orderBy("seq").limit(pool)
    mark = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return rows.where(~F.coalesce("paid_only", F.lit(False))).orderBy(mark, id_col).limit(n)


def python_template(snippets):
    """Code of the first snippet for python3 in an array of ``{langSlug, code}``."""
    return F.try_element_at(F.filter(snippets, lambda s: s.langSlug == "python3"), F.lit(1)).code


def with_difficulty(trials: DataFrame, problems: DataFrame) -> DataFrame:
    """Left join by frontend id, ``Unknown`` where no problem is known.

    No broadcast hint: the planner broadcasts a problem table it knows to be small, and splits a hot
    problem's side otherwise.
    """
    dim = problems.select(
        F.col("frontend_question_id").alias("problem_id"),
        labels.clean_difficulty(F.col("difficulty")).alias("difficulty"),
    )
    return trials.join(dim, "problem_id", "left").fillna("Unknown", ["difficulty"])


def tier_order(difficulty):
    """0 for Easy up to 3 for anything unknown."""
    out = F.lit(TIERS["Unknown"])
    for name, order in TIERS.items():
        out = F.when(difficulty == name, F.lit(order)).otherwise(out)
    return out


def cap_trials(trials: DataFrame, k: int) -> DataFrame:
    """The first k trials of every cell, as a cheaper run would have made them."""
    return trials.where(F.col("trial_index") < k)


def filter_runs(trials: DataFrame, models: list[str] | None, prompts: list[str] | None) -> DataFrame:
    """Rows of the requested models and prompts; None asks for all."""
    out = trials
    if models is not None:
        out = out.where(F.col("model_name").isin(*models))
    if prompts is not None:
        out = out.where(F.col("strategy").isin(*prompts))
    return out


def dataset_stats(problems: DataFrame, top: int = 15) -> DataFrame:
    """(kind, label, count): number of problems, problems per difficulty, and the top topics."""
    total = problems.agg(
        F.lit("problems").alias("kind"), F.lit("all").alias("label"), F.count(F.lit(1)).alias("count")
    )
    by_tier = problems.groupBy(
        F.lit("difficulty").alias("kind"),
        F.coalesce(labels.clean_difficulty(F.col("difficulty")), F.lit("Unknown")).alias("label"),
    ).agg(F.count(F.lit(1)).alias("count"))
    topics = (
        problems.select(F.explode(labels.split_topics(F.col("topics"))).alias("label"))
        .groupBy(F.lit("topic").alias("kind"), "label")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "label")
        .limit(top)
    )
    return total.unionByName(by_tier).unionByName(topics)
