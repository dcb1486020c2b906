"""Makes the package importable in Python workers wherever the driver found it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
TOP = Path(__file__).resolve().parent


def _workers_find_it(master: str) -> bool:
    """Workers have the driver's PYTHONPATH, and in local mode its working folder too."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if master == "local" or master.startswith("local["):
        paths.append(Path.cwd())
    return TOP.parent in paths


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once per Spark application and only where they need it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped or _workers_find_it(sc.master):
        return
    d = tempfile.mkdtemp(prefix="keystrata-")  # executors may fetch it at any time
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = Path(d) / "keystrata.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(TOP.rglob("*.py")):
            z.write(f, f.relative_to(TOP.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
