"""The query catalogue: each query with the SQL its result must equal, where there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ["q_stability", "q_report", "q_crossrun", "q_sources", "q_requests", "q_answers", "q_live"]


def catalogue() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found = importlib.import_module(f"steadyrun.plans.{name}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(found)
    return out
