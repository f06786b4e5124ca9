"""Sends this package to the executors, so that its Python functions run there without an installation."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source as a zip file to the session's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder) / "copy"
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="motifmill-"), root.name), "zip", copy)
    sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)
