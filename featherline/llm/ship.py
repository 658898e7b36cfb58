"""Send this package to the executors, for sessions started without it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's source to the application once; Spark hands it out from the driver."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        folder = tempfile.mkdtemp(prefix="featherline-source-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name)
        context.addPyFile(archive)
        _sent.add(context.applicationId)
