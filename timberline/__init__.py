"""Spark-native analytics of forest laser scans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package, wherever the driver found it; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="timberline-")  # the driver serves the file for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "timberline_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("timberline", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
