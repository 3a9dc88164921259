"""Sends the package to the executors that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import graphloom
from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the application's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = Path(graphloom.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
