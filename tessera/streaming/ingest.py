"""Structured Streaming extensions: incremental chunking and windowed usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.chunking import recursive_chunks


def documents(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def ingest(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk what has arrived and append it; a replayed batch overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        recursive_chunks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """``(start, kind, n)``: events of each kind a window; rows later than the watermark are dropped by design."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events without a gap."""
    w = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
