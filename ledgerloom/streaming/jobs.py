"""Streams: hourly token totals and the statement pipeline in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_totals(events: DataFrame, late: str | None = None) -> DataFrame:
    """``hour, tokens`` of a stream (or table) of ``ts, tokens``; with ``late``, state of hours that old goes."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum("tokens").alias("tokens")).select(F.col("w.start").alias("hour"), "tokens")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Everything available into a memory table, then stop."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _batch_folder(path: str, number: int) -> str:
    """A micro-batch's own folder, written over if the batch is run again."""
    return f"{path.rstrip('/')}/batch={number}"


def totals_in_batches(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What changed in ``totals`` (an aggregated stream), as Parquet by micro-batch: neither the driver nor a batch holds all of them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(path, number))

    empty = totals.sparkSession.createDataFrame([], totals.schema)
    empty.write.mode("overwrite").parquet(_batch_folder(path, -1))  # a stream without rows has a table too
    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(written: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``totals_in_batches`` as they were last written for ``keys``."""
    values = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def parse_in_batches(uploads: DataFrame, pipeline, path: str, checkpoint: str) -> StreamingQuery:
    """The batch pipeline (documents to responses) over each micro-batch of an upload stream, as JSON lines in a folder of the batch."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline(batch).select("response").write.mode("overwrite").text(_batch_folder(path, number))

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
