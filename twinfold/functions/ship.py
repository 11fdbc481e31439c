"""Giving Python workers this package, on clusters where it isn't installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        name = Path(tempfile.mkdtemp(prefix="twinfold-code-")) / "twinfold_code.zip"
        name.write_bytes(data.getvalue())
        sc.addPyFile(str(name))
        _shipped.add(sc.applicationId)
    return spark
