"""Session settings the operators are designed for, and what Python steps need on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "clauseloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; a cluster's own settings (master, checkpoint folder) are kept."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="clauseloom-")) / package.name
        context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


#: Bytes of an Arrow batch sent to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts can't fill a worker; a bound set by the user stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))
