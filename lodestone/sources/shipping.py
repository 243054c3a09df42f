"""Makes this package known to Python workers that would not find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


def found_by_workers() -> bool:
    """Workers look in PYTHONPATH and in the folder that the driver was started in."""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == _ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Send the package as a zip through Spark, once an application, where workers would not find it by themselves."""
    app = spark.sparkContext.applicationId
    if app in _done or found_by_workers():
        return
    folder = tempfile.mkdtemp()
    source = os.path.join(folder, "source")
    shutil.copytree(_ROOT / "lodestone", os.path.join(source, "lodestone"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "lodestone"), "zip", source))
    _done.add(app)
