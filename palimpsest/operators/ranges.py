"""Key ranges: containment, routing, splitting, snapshots of a range.

A range is (id, start, end) on binary keys; an empty end means no limit. The ranges
of a keyspace are disjoint and cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidArgument
from palimpsest.functions.codec import bounds_text
from palimpsest.operators.versions import in_range
from palimpsest.sources.shared import written

RANGES = "id int, start binary, end binary"


def whole(spark: SparkSession) -> DataFrame:
    """The first range, which holds every key."""
    return spark.createDataFrame([(1, bytearray(), bytearray())], RANGES)


def reserved(key: Column) -> Column:
    """Whether a raw key belongs to the system (00) or to transactions ('!')."""
    return F.coalesce(F.substring(key, 1, 1).isin(bytearray(b"\0"), bytearray(b"!")), F.lit(False))


def contains(key: Column, start: Column, end: Column) -> Column:
    return in_range(key, start, end)


def route(keys: DataFrame, ranges: DataFrame, key: str = "key", most_broadcast: int = 1000) -> DataFrame:
    """Keys with the id of their range, the one with the last start at or before the key.

    Up to `most_broadcast` ranges are broadcast. More are as-of joined: starts and keys
    are sorted together over range partitions and each key takes the last start before it, so
    neither side is sent whole to any task.
    """
    if ranges.limit(most_broadcast + 1).count() <= most_broadcast:
        own = F.broadcast(ranges.select(F.col("id").alias("range_id"), F.col("start").alias("_start"), F.col("end").alias("_end")))
        return keys.join(own, contains(F.col(key).cast("binary"), F.col("_start"), F.col("_end"))).drop("_start", "_end")
    row = F.struct(*[keys[c] for c in keys.columns])
    starts = ranges.select(F.col("start").alias("_key"), F.col("id").alias("_id"), F.lit(None).cast(keys.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    rows = keys.select(F.col(key).cast("binary").alias("_key"), F.lit(None).cast("int").alias("_id"), row.alias("_row"))
    sort = ["_key", F.col("_row").isNotNull()]
    both = starts.unionByName(rows).repartitionByRange("_key").sortWithinPartitions(*sort)
    both = written(both.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_order")), "routed")
    last = Window.partitionBy("_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_found", F.last("_id", ignorenulls=True).over(last)).filter("_row is not null")
    # A partition may begin inside a range: its first keys take the last start of the partitions before it.
    ends = both.filter("_id is not null").groupBy("_part").agg(F.max_by("_id", "_order").alias("_last")).withColumnRenamed("_part", "_from")
    before = both.select("_part").distinct().join(ends, F.col("_from") < F.col("_part")).groupBy("_part").agg(F.max_by("_last", "_from").alias("_carried"))
    return filled.join(before, "_part", "left").select("_row.*", F.coalesce("_found", "_carried").alias("range_id"))


def intersecting(ranges: DataFrame, start: bytes, end: bytes) -> DataFrame:
    """Ranges that share a key with [start, end), in key order."""
    before_end = F.lit(True) if not end else F.col("start") < F.lit(bytearray(end))
    after_start = (F.octet_length("end") == 0) | (F.col("end") > F.lit(bytearray(start)))
    return ranges.filter(before_end & after_start).orderBy("start")


def split(ranges: DataFrame, key: bytes) -> DataFrame:
    """Ranges after a split at `key`: the parent ends there, a child with the next id begins."""
    at = F.lit(bytearray(key))
    parent = ranges.filter(contains(at, F.col("start"), F.col("end"))).first()
    if parent is None or bytes(parent.start) == key:
        raise InvalidArgument("split key not strictly inside range")
    child = ranges.agg((F.max("id") + 1).cast("int").alias("id")).select("id", at.alias("start"), F.lit(parent.end).alias("end"))
    shrunk = ranges.select("id", "start", F.when(F.col("id") == parent.id, at).otherwise(F.col("end")).alias("end"))
    return shrunk.unionByName(child)


def described(ranges: DataFrame) -> DataFrame:
    """Ranges in key order with their bounds as text."""
    return ranges.select("id", bounds_text(F.col("start"), F.col("end")).alias("bounds"), "start").orderBy("start").drop("start")


def owned(table: DataFrame, start: bytes, end: bytes, key: str = "key") -> DataFrame:
    """The rows of a range: what its snapshot holds."""
    return table.filter(contains(F.col(key), F.lit(bytearray(start)), F.lit(bytearray(end))))


def restored(table: DataFrame, snapshot: DataFrame, start: bytes, end: bytes, key: str = "key") -> DataFrame:
    """A table whose range is replaced by a snapshot of it."""
    outside = table.filter(~contains(F.col(key), F.lit(bytearray(start)), F.lit(bytearray(end))))
    return outside.unionByName(snapshot)
