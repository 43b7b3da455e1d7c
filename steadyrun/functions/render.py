"""Text forms of table rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values, applied in this order, so that braces written by the first one are escaped too.
LATEX_ESCAPES = [
    ("\\", "\\textbackslash{}"),
    ("&", "\\&"),
    ("%", "\\%"),
    ("$", "\\$"),
    ("#", "\\#"),
    ("_", "\\_"),
    ("{", "\\{"),
    ("}", "\\}"),
]

# Display names of model ids that have one.
DISPLAY_NAMES = {
    "gemini-3.1-pro-preview": "Gemini 3.1 Pro",
    "deepseek-r1": "DeepSeek-R1",
    "gemini-3-flash-preview": "Gemini 3 Flash",
    "qwq-plus": "QwQ-Plus",
    "gemini-3.1-flash-lite-preview": "Gemini 3.1 Flash-Lite",
    "qwen-plus": "Qwen-Plus",
    "gpt-4.1": "GPT-4.1",
    "gpt-4.1-mini": "GPT-4.1-mini",
    "claude-sonnet-4-5-20250929": "Claude Sonnet 4.5",
    "deepseek-v3.2": "DeepSeek-V3.2",
    "claude-haiku-4-5-20251001": "Claude Haiku 4.5",
    "qwen-turbo": "Qwen-Turbo",
    "qwen-max": "Qwen-Max",
}


def number_text(value: Column, decimals: int) -> Column:
    """Shortest decimal text of an already rounded number, with at least one decimal."""
    fixed = F.format_string(f"%.{decimals}f", value)
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def interval_text(lo: Column, hi: Column, decimals: int = 2, suffix: str = "") -> Column:
    """``[lo, hi]`` with fixed decimals, ``N/A`` where a bound is missing."""
    shape = f"[%.{decimals}f{suffix}, %.{decimals}f{suffix}]".replace("%,", "%%,").replace("%]", "%%]")
    return F.when(lo.isNull() | hi.isNull(), F.lit("N/A")).otherwise(F.format_string(shape, lo, hi))


def markdown_row(cols: Sequence[Column]) -> Column:
    cells = [F.coalesce(c.cast("string"), F.lit("None")) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_head(names: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]


def latex_escape(col: Column) -> Column:
    out = F.coalesce(col.cast("string"), F.lit("None"))
    for old, new in LATEX_ESCAPES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def latex_row(cols: Sequence[Column]) -> Column:
    return F.concat(F.concat_ws(" & ", *[latex_escape(c) for c in cols]), F.lit(" \\\\"))


def latex_head(names: Sequence[str]) -> list[str]:
    def escape(text: str) -> str:
        for old, new in LATEX_ESCAPES:
            text = text.replace(old, new)
        return text

    return [
        "\\begin{tabular}{" + "l" * len(names) + "}",
        "\\hline",
        " & ".join(escape(n) for n in names) + " \\\\",
        "\\hline",
    ]


LATEX_FOOT = ["\\hline", "\\end{tabular}"]


def display_name(model: Column) -> Column:
    """Display name of a model id, or the id itself."""
    pairs = [F.lit(x) for pair in DISPLAY_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), model), model)


def table_lines(df: DataFrame, row: Column, head: Sequence[str], foot: Sequence[str] = ()) -> DataFrame:
    """``(line_no, line)``: heading lines count up from 1 - len(head), rows follow at 1 onwards.

    Row order must be in ``df`` as a column ``row_no``; nothing is collected.
    """
    spark = df.sparkSession
    fixed = [(i + 1 - len(head), text) for i, text in enumerate(head)]
    lines = df.select(F.col("row_no").cast("bigint").alias("line_no"), row.alias("line"))
    out = spark.createDataFrame(fixed, "line_no bigint, line string").unionByName(lines)
    if foot:
        tail = spark.createDataFrame(list(enumerate(foot, 1)), "step bigint, line string")
        count = df.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("n")).scalar()
        out = out.unionByName(tail.select((F.col("step") + count).alias("line_no"), "line"))
    return out
