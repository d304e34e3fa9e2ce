"""Every query of the library has an oracle, and page folds run where the package is not on the workers' path."""

import subprocess
import sys
from pathlib import Path

from folioscope.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_folds_run_from_another_folder(tmp_path):
    """The driver finds the package by sys.path only; workers get it sent."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from folioscope.plans import registry
q = registry.queries()
print("ROWS", q["native_lines"](spark, "/root/testdata/sf0.001").count(), q["unique_texts"](spark, "/root/testdata/sf0.001").count(), q["glyph_audit"](spark, "/root/testdata/sf0.001").count())
"""
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK")) or k in ("PATH", "LANG")}}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 5441" in done.stdout, done.stderr[-2000:]
