"""Spark session with this engine's settings, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
PACKAGE = Path(__file__).resolve().parent


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; settings given by name win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in every Python worker, once for each Spark context."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":  # unless someone chose otherwise: texts can be long, and so batches large
        spark.conf.set(BATCH_ROWS, "2000")
    if getattr(sc, "_weftline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="weftline-")
    target = os.path.join(folder, "weftline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(target)
    sc._weftline_shipped = True
