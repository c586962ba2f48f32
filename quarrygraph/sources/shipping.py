"""Make this package importable on the executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, buffer = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="quarrygraph-")) / "quarrygraph.zip"
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
