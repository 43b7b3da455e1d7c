"""Code extraction from free answer text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# What may open a reasoning block, a fenced block and a line of code.
THINK_BLOCK = r"(?is)<think>.*?</think>"
THINKING_BLOCK = r"(?is)<\|thinking\|>.*?<\|/thinking\|>"
FENCED_BLOCK = r"(?sU)```(?:python|python3)?\s*\n(.*?)\n```"
CLASS_BLOCK = r"(?sU)(class\s+\w+.*?)(?=\n(?:class|def)\s|\z)"
CODE_LINE = r"(?mdU)^\s*(?:def|class|import|from|return) [^\n]*\S"

# All white space there is below the ideographic space, by Python's own rule.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Remove white space of any kind, newlines included, from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def drop_reasoning(text: Column) -> Column:
    """Text without reasoning blocks, or the text as it was when nothing else is in it."""
    bare = F.regexp_replace(F.regexp_replace(text, THINK_BLOCK, ""), THINKING_BLOCK, "")
    return let(strip(bare), lambda b: F.when(b == "", text).otherwise(b))


def code_in(body: Column) -> Column:
    """First fenced block, else first class, else text that has a code line, else null."""
    return (
        F.when(body.rlike(FENCED_BLOCK), strip(F.regexp_extract(body, FENCED_BLOCK, 1)))
        .when(body.rlike(CLASS_BLOCK), strip(F.regexp_extract(body, CLASS_BLOCK, 1)))
        .when(body.rlike(CODE_LINE), body)
        .when(
            F.contains(body, F.lit("class ")),
            strip(F.concat(F.lit("class "), F.regexp_replace(body, r"(?s)\A.*?class ", ""))),
        )
    )


def extract_code(text: Column) -> Column:
    """The code in a free answer, reasoning blocks set aside; null where there is none."""
    return F.when(text != "", let(drop_reasoning(text), code_in))


# Two characters Unicode leaves to private use stand in for escaped pairs while one is unescaped.
_SLASH, _QUOTE = "\ue000", "\ue001"


def loose_code_value(raw: Column) -> Column:
    """The quoted value after ``"code":`` in JSON too broken to parse; raw newlines are dropped."""
    opening = r'(?sU)"code"\s*:\s*"(.*)'
    tail = F.regexp_extract(raw, opening, 1)
    masked = F.replace(F.replace(tail, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    value = F.replace(F.substring_index(masked, '"', 1), F.lit("\n"), F.lit(""))
    for escaped, plain in (("\\n", "\n"), ("\\t", "\t"), (_QUOTE, '"'), (_SLASH, "\\")):
        value = F.replace(value, F.lit(escaped), F.lit(plain))
    return value


def structured_code(raw: Column) -> Column:
    """``code`` of a JSON answer, strictly parsed or else read loosely; otherwise the raw text."""

    def read(parsed: Column) -> Column:
        strict = F.try_variant_get(parsed, "$.code", "string")
        loose = let(loose_code_value(raw), lambda v: F.when(strip(v) != "", v))
        return F.coalesce(strict, F.when(parsed.isNull(), loose), raw)

    return let(F.try_parse_json(raw), read)


def is_valid_python(code: Column) -> Column:
    """Whether the code compiles. It is never run.

    The function is nested so that it travels to the executors by value: they need no copy of
    this package.
    """

    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import warnings

        def compiles(text):
            if text is None:
                return None
            try:
                compile(text, "<answer>", "exec")
                return True
            except (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError):
                return False

        for batch in batches:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                yield batch.map(compiles).astype("object")

    return F.pandas_udf(check, T.BooleanType())(code)
