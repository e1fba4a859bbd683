"""Sends this package to the executors, whose Python need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts in one Arrow batch, where the session's settings name no number.
BATCH_ROWS = 1500


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once for each application, and keeps Arrow batches of texts small."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*")):
                if p.suffix in (".py", ".yaml"):
                    z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))
        if not spark.sparkContext.getConf().contains(_BATCH):
            spark.conf.set(_BATCH, BATCH_ROWS)
        _sent.add(app)
    return spark
