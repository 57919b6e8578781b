"""Incremental ingest and windowed rates on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill import schemas


def gold_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schemas.GOLD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def ingest(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], chunks_path: str, checkpoint: str) -> StreamingQuery:
    """Chunks new documents batch by batch into a table; documents that an
    earlier batch brought are passed over.

    Which are known is keyed state: the stream's deduplication keeps nothing
    but the keys, sharded by key and on disk (RocksDB), and a batch asks for
    its own keys only, so what a batch costs does not grow with the table. A
    batch that runs again after a failure starts from the state before it and
    replaces its own part, so each chunk is there once.
    """
    spark, store = docs.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def one(batch: DataFrame, epoch: int) -> None:
            chunker(batch).write.mode("overwrite").parquet(f"{chunks_path}/epoch={epoch}")

        new = docs.dropDuplicates(["source_type", "doc_id"])
        return new.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need an instant; a time without zone is read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values per window and type; later ones than ``late``
    are left out once their window has closed. Works on tables, too."""
    w = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events that follow one another within ``gap``."""
    s = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
