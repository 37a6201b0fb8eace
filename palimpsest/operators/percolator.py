"""Snapshot transactions over lock, write and data records, many requests at once.

locks:  key, start_ts, op, wall_ms, primary_key      (op 1 put, 2 delete)
writes: key, commit_ts, kind, start_ts               (kind 1 put, 2 delete, 3 rollback)
data:   key, start_ts, value
Every function joins requests to records on the key; nothing loops over keys.
Requests are independent of each other: each sees the records as given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.versions import in_range, newest

PUT, DELETE, ROLLBACK = 1, 2, 3
LOCK_TTL_MS = 3000


def lock_of(locks: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys with their lock, null where free."""
    return keys.join(locks, "key", "left")


def history(writes: DataFrame, key: bytes | str, ts: int) -> DataFrame:
    """A key's write records at or below `ts`, newest first."""
    return writes.filter((F.col("key") == F.lit(key)) & (F.col("commit_ts") <= ts)).orderBy(F.desc("commit_ts"))


def newest_writes(writes: DataFrame, ts: int | Column) -> DataFrame:
    """Per key the newest write at or below `ts` that isn't a rollback."""
    return newest(writes.filter((F.col("commit_ts") <= ts) & (F.col("kind") != ROLLBACK)), ["key"], ["commit_ts"])


def get(locks: DataFrame, writes: DataFrame, data: DataFrame, keys: DataFrame, ts: int) -> DataFrame:
    """Point reads at `ts`: key, status (ok, not found, locked), value, lock_ts."""
    held = locks.filter(F.col("start_ts") <= ts).select("key", F.col("start_ts").alias("lock_ts"))
    found = newest_writes(writes, ts).filter(F.col("kind") == PUT).join(data, ["key", "start_ts"]).select("key", "value", F.lit(True).alias("found"))
    out = keys.join(held, "key", "left").join(found, "key", "left")
    locked = F.col("lock_ts").isNotNull()
    status = F.when(locked, "locked").when(F.col("found"), "ok").otherwise("not found")
    return out.select("key", status.alias("status"), F.when(~locked, F.col("value")).alias("value"), "lock_ts")


def blocking_lock(locks: DataFrame, start, end, ts: int) -> DataFrame:
    """The first lock in [start, end) that blocks a scan at `ts`: no row or one."""
    held = locks.filter(in_range("key", F.lit(start), F.lit(end)) & (F.col("start_ts") <= ts))
    return held.orderBy("key").limit(1)


def scan(writes: DataFrame, data: DataFrame, start, end, ts: int, limit: int | None = None) -> DataFrame:
    """Rows of [start, end) at `ts` in key order; the caller asks `blocking_lock` first."""
    near = in_range("key", F.lit(start), F.lit(end))
    rows = newest_writes(writes.filter(near), ts).filter(F.col("kind") == PUT).join(data.filter(near), ["key", "start_ts"]).select("key", "value")
    rows = rows.orderBy("key")
    return rows if limit is None else rows.limit(limit)


def outcome(writes: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, start_ts) requests with commit_ts (null if none) and rolled_back."""
    known = writes.groupBy("key", "start_ts").agg(
        F.max(F.when(F.col("kind") != ROLLBACK, F.col("commit_ts"))).alias("commit_ts"), F.max(F.col("kind") == ROLLBACK).alias("rolled_back")
    )
    return requests.join(known, ["key", "start_ts"], "left").withColumn("rolled_back", F.coalesce("rolled_back", F.lit(False)))


def _with_state(locks: DataFrame, writes: DataFrame, requests: DataFrame) -> DataFrame:
    held = locks.select("key", F.col("start_ts").alias("lock_ts"), F.col("op").alias("lock_op"), F.col("wall_ms").alias("lock_wall_ms"))
    return outcome(writes, requests).withColumnRenamed("commit_ts", "committed_ts").join(held, "key", "left")


def prewrite(locks: DataFrame, writes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (key, start_ts, ...) with `outcome`: aborted, conflict, replay or locked (a new lock).

    Checked in this order: rolled back at this timestamp; committed at or after
    it, by anyone; locked by another transaction; locked by this one.
    """
    last = writes.filter(F.col("kind") != ROLLBACK).groupBy("key").agg(F.max("commit_ts").alias("last_commit"))
    state = _with_state(locks, writes, requests).join(last, "key", "left")
    result = (
        F.when(F.col("rolled_back"), "aborted")
        .when(F.col("last_commit") >= F.col("start_ts"), "conflict")
        .when(F.col("lock_ts").isNotNull() & (F.col("lock_ts") != F.col("start_ts")), "conflict")
        .when(F.col("lock_ts") == F.col("start_ts"), "replay")
        .otherwise("locked")
    )
    return state.select(*requests.columns, result.alias("outcome"), "last_commit")


def commit(locks: DataFrame, writes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (key, start_ts, commit_ts) with `outcome`: committed, replay or aborted, and the write's kind."""
    asked = requests.withColumnRenamed("commit_ts", "asked_ts")
    state = _with_state(locks, writes, asked)
    own = F.col("lock_ts") == F.col("start_ts")
    result = F.when(own, "committed").when(F.col("committed_ts").isNotNull(), "replay").otherwise("aborted")
    kind = F.when(own, F.when(F.col("lock_op") == DELETE, DELETE).otherwise(PUT))
    return state.select("key", "start_ts", F.col("asked_ts").alias("commit_ts"), result.alias("outcome"), kind.alias("kind"))


def rollback(locks: DataFrame, writes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (key, start_ts) with `outcome`: conflict (committed), replay (marked before) or rolled back."""
    state = _with_state(locks, writes, requests)
    result = F.when(F.col("committed_ts").isNotNull(), "conflict").when(F.col("rolled_back"), "replay").otherwise("rolled back")
    return state.select("key", "start_ts", result.alias("outcome"), (F.col("lock_ts") == F.col("start_ts")).alias("had_lock"))


def expired(now_ms: int | Column, wall_ms: Column, ttl_ms: int = LOCK_TTL_MS) -> Column:
    """Whether a lock's time is over; a pure function of its arguments."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return now >= wall_ms + ttl_ms


def resolve(locks: DataFrame, writes: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """Fate of transactions asked of their primary (key, start_ts): alive, committed at commit_ts, or rolled back (0)."""
    state = _with_state(locks, writes, requests)
    own = F.col("lock_ts") == F.col("start_ts")
    alive = own & ~expired(now_ms, F.col("lock_wall_ms"))
    fate = F.when(alive, "alive").when(F.col("committed_ts").isNotNull(), "committed").otherwise("rolled back")
    marks = ~F.coalesce(alive, F.lit(False)) & F.col("committed_ts").isNull() & ~F.col("rolled_back")
    ts = F.when(alive, F.lit(None).cast("long")).otherwise(F.coalesce("committed_ts", F.lit(0)))
    return state.select("key", "start_ts", fate.alias("fate"), ts.alias("commit_ts"), marks.alias("writes_marker"))


def apply_commits(locks: DataFrame, writes: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locks, writes) after the commits that `commit` found possible."""
    done = results.filter("outcome = 'committed'")
    left = locks.join(done.select("key", "start_ts"), ["key", "start_ts"], "left_anti")
    return left, writes.unionByName(done.select("key", "commit_ts", "kind", "start_ts"))


def apply_rollbacks(locks: DataFrame, writes: DataFrame, data: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(locks, writes, data) after the rollbacks that `rollback` found possible."""
    done = results.filter("outcome = 'rolled back'")
    held = done.filter("had_lock").select("key", "start_ts")
    marks = done.select("key", F.col("start_ts").alias("commit_ts"), F.lit(ROLLBACK).alias("kind"), "start_ts")
    return locks.join(held, ["key", "start_ts"], "left_anti"), writes.unionByName(marks), data.join(held, ["key", "start_ts"], "left_anti")
