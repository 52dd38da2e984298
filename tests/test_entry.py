"""The entry module in a process of its own: it has to import, and its flagship query to run, without a session made before."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
IMPORTS = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
RUNS = "from pyspark.sql import SparkSession; import __spark_entry__ as e; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.entry(s).count() >= 0; s.stop()"


def run(code: str) -> None:
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_imports_without_a_session():
    run(IMPORTS)


def test_flagship_runs_in_a_fresh_process():
    run(RUNS)
