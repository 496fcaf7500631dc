"""Ships this package to Python workers that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package as a zip, unless the workers' PYTHONPATH has it already."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    if any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    path = Path(tempfile.mkdtemp()).resolve() / "tallgrass.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((ROOT / "tallgrass").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
