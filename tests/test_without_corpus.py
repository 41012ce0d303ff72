"""The engine stands without the text subpackage: its folders, with or without the pipeline's file, may be gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import importlib.util
import __spark_entry__ as entry
names, sql = entry.queries(), entry.oracle_sql()
assert "burst_summary" in names and set(sql) <= set(names)
assert not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).schema
"""


@pytest.mark.parametrize("gone", [("framesift/llm", "tests/llm"), ("framesift/llm", "tests/llm", "corpus_pipeline.py"), ("framesift/llm/*.py", "tests/llm")])
def test_registry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for pattern in gone:
        for found in copy.glob(pattern):
            shutil.rmtree(found) if found.is_dir() else found.unlink()
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env={**__import__("os").environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_core_module_imports_the_subpackage():
    for path in ROOT.glob("framesift/**/*.py"):
        if "llm" not in path.parts:
            assert "framesift.llm" not in path.read_text(), path
