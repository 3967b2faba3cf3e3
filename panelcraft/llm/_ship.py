"""Make this package importable in Python workers wherever it is only on the driver's path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: bytes of rows that reach a Python task at a time, at most (or a single row)
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once per application.

    Rows of this package's Python stages can be texts of megabytes, so batches are bounded by bytes too.
    """
    sc = spark.sparkContext
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
