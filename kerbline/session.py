"""Making the library importable on executors, and bounding what their Python workers hold."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of a batch that a Python worker gets at once; a session's own settings go first.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once for each Spark context, and set BATCH where it is unset."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if not getattr(sc, "_kerbline_shipped", False):
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="kerbline-src-")) / "kerbline.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(path))  # the driver serves it to every executor
        sc._kerbline_shipped = True
    return spark
