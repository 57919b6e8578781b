"""Lets Python workers import this package from where it lies."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Rows and bytes of an Arrow batch. Texts may be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def reach(spark: SparkSession) -> None:
    """Bounds the Arrow batches, so that a worker holds few texts at once, and
    adds the package's folder to the path of workers started from now on.
    On a cluster the package is installed or shipped (``--py-files``)."""
    prefix = "spark.sql.execution.arrow."
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(prefix + key, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(prefix + key, str(most))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
