"""Getting the package itself to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless their PYTHONPATH has it already."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    folder = Path(tempfile.mkdtemp(prefix="lumenspan-code-"))
    shutil.copytree(ROOT / "lumenspan", folder / "src/lumenspan", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / "lumenspan"), "zip", folder / "src"))
