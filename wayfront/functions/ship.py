"""Ship this package's sources to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark once per application, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    handle, name = tempfile.mkstemp(prefix="wayfront-", suffix=".zip")
    with os.fdopen(handle, "wb") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, Path(root.name) / source.relative_to(root))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
