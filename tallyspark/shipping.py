"""Makes the package importable on workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once an application, unless their path holds it already."""
    top = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(top) in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        return
    _shipped.add(app)
    path = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(str(path))
