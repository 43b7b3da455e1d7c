"""Label and number cleaning expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Historic prompt labels and the names they now go by.
LEGACY_LABELS = {"with_prompt": "detailed", "without_prompt": "minimal"}
ACCEPTED = "Accepted"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def normalize_strategy(strategy: Column, prompt_type: Column | None = None) -> Column:
    """``strategy``, else ``prompt_type``, else ``default``; old spellings mapped to new ones."""
    options = [blank_to_null(strategy)]
    if prompt_type is not None:
        options.append(blank_to_null(prompt_type))
    label = F.coalesce(*options, F.lit("default"))
    mapped = label
    for old, new in LEGACY_LABELS.items():
        mapped = F.when(label == old, F.lit(new)).otherwise(mapped)
    return mapped


def accepted(status: Column) -> Column:
    """1 for an exact ``Accepted``, 0 for anything else including null."""
    return F.coalesce((status == ACCEPTED).cast("int"), F.lit(0))


def coerce_numeric(col: Column) -> Column:
    """Double, or null where the text is no number."""
    return col.try_cast("double")


def clean_difficulty(col: Column) -> Column:
    return F.initcap(F.trim(col))


def sanitize(col: Column) -> Column:
    """Every run of characters outside ``A-Za-z0-9._-`` becomes one underscore."""
    return F.regexp_replace(col, "[^A-Za-z0-9._-]+", "_")


def split_topics(topics: Column) -> Column:
    """Comma-joined topics as a trimmed array."""
    return F.transform(F.split(topics, ","), lambda t: F.trim(t))
