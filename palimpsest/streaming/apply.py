"""Ordered, exactly-once apply of versioned records from a stream of files.

Structured Streaming delivers every file once per checkpoint but may replay a batch after a
failure; the sink keeps one folder per batch number and replaces it, so a
replay changes nothing. The state is the newest record per key at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.versions import newest, visible


def apply_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply records (key, seqno, op, ...) from Parquet files in `source` to `sink`."""

    def batch(records: DataFrame, number: int) -> None:
        newest(records, ["key"], ["seqno"]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def applied(spark: SparkSession, sink: str, upto: int | None = None) -> DataFrame:
    """The state after all applied records, or those with seqno at most `upto`."""
    records = spark.read.parquet(sink).drop("batch")
    if upto is not None:
        records = records.filter(F.col("seqno") <= upto)
    return visible(records)


def versions_per_window(events: DataFrame, time: str, size: str, late: str) -> DataFrame:
    """Applied versions per tumbling window, for watching a stream; late records beyond the watermark are not counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, size)).agg(F.count("*").alias("versions"))
