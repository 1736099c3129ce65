"""Gives the executors' Python workers this package, once per context."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE = "nightloom.library_shipped"


def ship_library(spark: SparkSession) -> None:
    """Send the package's code, which Spark copies to every executor; kernels that it pickles by name are then found there."""
    context = spark.sparkContext
    if getattr(context, _DONE, False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), "nightloom_library.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(target)
    setattr(context, _DONE, True)
