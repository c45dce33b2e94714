"""An extension of ours: signals that arrive as a stream, counted by window, and appended once to a table of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def by_window(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Signals by window and rule. stream: ts, rule_id, fingerprint. State of a window goes when it can't change any more."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "rule_id").agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each fingerprint once within what the watermark keeps."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])


def append_findings(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is new; a batch that is tried again replaces its own folder, so that nothing appears twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return first_seen(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
