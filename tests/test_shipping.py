import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_workers_without_the_package_get_it(tmp_path):
    """A driver that finds the package by sys.path alone, from another folder."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
import __spark_entry__
print("rows", len(__spark_entry__.oracle_sql()) > 0, __spark_entry__.queries()["q_checksums"](s, "/root/testdata/sf0.001").collect()[:1])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "PATH")}, capture_output=True, text=True, timeout=300)
    assert "rows " in out.stdout, out.stderr[-2000:]
