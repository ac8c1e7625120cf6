"""Give executors this package, wherever the driver found it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    at = Path(tempfile.mkdtemp(prefix="motifmill-")).resolve() / "motifmill-src.zip"
    at.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
