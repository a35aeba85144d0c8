"""The package on the executors: Python tasks import it, wherever the driver has it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors of the application, once; Spark serves the file from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sievework-")) / "sievework-sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
