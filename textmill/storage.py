"""Tables and folders that tasks share while a job goes on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="textmill-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine an own one
    where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(shared or _own_folder()).rstrip('/')}/textmill/queries-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: its lineage ends, and it is not
    worked out twice."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
