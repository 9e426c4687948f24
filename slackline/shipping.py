"""Sends this package to executors, whose Python may start anywhere."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_slackline_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="slackline-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    sc.addPyFile(str(path))
    sc._slackline_shipped = True
