"""Hands the package to Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the context, once, unless the workers start where it can be imported."""
    context = spark.sparkContext
    found = ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == ROOT
    if found or context.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidewire-"), "tidewire.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "tidewire")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
