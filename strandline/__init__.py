"""Scoring, localisation, batching and selection of ragged token sequences on Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application.

    Spark hands the file on to every executor, those that come later too, so the
    package need not be installed on the cluster's machines.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="strandline-")).resolve() / "strandline.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(here.rglob("*.py")):
                out.write(f, f.relative_to(here.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
