"""Versioned records: newest wins, tombstones, merging, compaction, level statistics.

Records are (key, seqno, op, value) with op 1 for a put and 2 for a delete.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE = 1, 2


def newest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record of each key.

    `row_number() = 1` plans as a group limit on both sides of the shuffle, so each task
    sends one row per key and a key with a third of all rows costs no more than any other.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return records.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merged(levels: list[DataFrame]) -> DataFrame:
    """All records of several runs; order is imposed only where a result is shown."""
    return reduce(DataFrame.unionByName, levels)


def visible(records: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Newest records that are not deletes."""
    return newest(records, keys or ["key"], order or ["seqno"]).filter(F.col("op") == PUT)


def as_of(records: DataFrame, ts: int, keys: list[str], time: str) -> DataFrame:
    """The state at `ts`: what was newest then, without deleted keys."""
    return visible(records.filter(F.col(time) <= ts), keys, [time])


def compact(records: DataFrame, deeper: DataFrame | None) -> DataFrame:
    """One record per key; a delete is dropped only if no deeper run may hold its key.

    `deeper` has the key ranges (smallest, largest) of all runs below the output; None means there are none.
    """
    kept = newest(records, ["key"], ["seqno"])
    if deeper is None:
        return kept.filter(F.col("op") == PUT)
    covers = (F.col("key") >= F.col("smallest")) & (F.col("key") <= F.col("largest"))
    gone = kept.filter(F.col("op") == DELETE)
    needed = gone.join(deeper.select("smallest", "largest"), covers, "left_semi")
    return kept.filter(F.col("op") == PUT).unionByName(needed)


def table_meta(records: DataFrame, level: str = "level") -> DataFrame:
    """Per run: least and largest key, number of records, highest seqno."""
    return records.groupBy(level).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count("*").alias("entries"), F.max("seqno").alias("last_seqno")
    )


def level_limits(levels: DataFrame, first_bytes: int = 8 << 20, factor: int = 10, level_zero_files: int = 4) -> DataFrame:
    """Per level (level, files, bytes): its target and whether it wants compaction."""
    target = F.when(F.col("level") == 0, F.lit(None).cast("long")).otherwise((F.lit(first_bytes) * F.pow(F.lit(factor), F.col("level") - 1)).cast("long"))
    due = F.when(F.col("level") == 0, F.col("files") >= level_zero_files).otherwise(F.col("bytes") > target)
    return levels.withColumn("target_bytes", target).withColumn("due", due)


def entry_order(records: DataFrame) -> DataFrame:
    """Key ascending, newest first within a key."""
    return records.orderBy("key", F.desc("seqno"))


def overlay(snapshot: DataFrame, buffered: DataFrame, key: str = "key") -> DataFrame:
    """A snapshot with a transaction's own buffered writes (op, key, ...) on top."""
    puts = buffered.filter(F.col("op") == PUT).drop("op")
    return snapshot.join(buffered.select(key), key, "left_anti").unionByName(puts)


def in_range(key: str | Column, start: Column, end: Column) -> Column:
    """start <= key < end, an empty end meaning no limit."""
    k = F.col(key) if isinstance(key, str) else key
    return (k >= start) & ((F.octet_length(end) == 0) | (k < end))
