"""The rest of the repository works in a copy without the text-preparation subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import __spark_entry__ as entry
from pyspark.sql import SparkSession
names = set(entry.queries())
assert not any(n.startswith("op") for n in names) and "pipeline" not in names and "stability_cells" in names
assert set(entry.oracle_sql()) <= names
import bench
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert entry.queries()["stability_cells"](spark, {SF!r}).count() > 0
assert entry.entry(spark).count() > 0
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_copy_without_the_subpackage(tmp_path, with_pipeline):
    gone = {"llm", ".git", "__pycache__"} | (set() if with_pipeline else {"corpus_pipeline.py"})
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda _, names: gone & set(names))
    assert not (copy / "steadyrun" / "llm").exists() and not (copy / "tests" / "llm").exists()
    env = os.environ | {"PYTHONPATH": str(copy)}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
