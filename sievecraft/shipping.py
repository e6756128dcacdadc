"""The library on the machines that run Python tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives every executor this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sievecraft-code-"), "sievecraft.zip")
    with zipfile.ZipFile(path, "w") as code:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    code.write(file, os.path.relpath(file, os.path.dirname(here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
