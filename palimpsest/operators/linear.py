"""Linearizability of recorded histories of single-key registers.

A write and the reads that saw its value are a cluster, which must take effect as one run of
operations. Two clusters can be ordered unless each has an operation that ends before one of
the other's begins, and a history without such a pair is legal; with values that are written once
this is decided by aggregates and one ordered pass over the clusters.

A history is legal if its operations can be ordered so that each takes effect between its
call and return and every read sees the register as it is then. An operation
whose outcome is unknown may take effect at any time after its call, or never.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_STATES = 5_000_000
UNDECIDED = "state limit exceeded (undecided)"


def _known() -> Column:
    return F.coalesce(F.col("outcome").isin("ok", "notfound"), F.lit(False))


def relevant(history: DataFrame) -> DataFrame:
    """Operations that can decide a verdict, with `known` outcomes; of the unknown ones go
    reads, writes whose value no read saw, and deletes called after the last read of nothing."""
    reads = history.filter((F.col("op") == "get") & _known())
    seen = reads.filter("result is not null").select("key", F.col("result").alias("value")).distinct().withColumn("seen", F.lit(True))
    nothing = reads.filter("result is null").groupBy("key").agg(F.max("returned").alias("last_nothing"))
    rows = history.join(seen, ["key", "value"], "left").join(nothing, "key", "left").withColumn("known", _known())
    useful = F.col("known") | ((F.col("op") == "put") & F.col("seen")) | ((F.col("op") == "del") & (F.col("invoked") <= F.coalesce("last_nothing", F.lit(-1.0))))
    return rows.filter(useful).select("id", "key", "op", "value", "result", "invoked", F.when(F.col("known"), F.col("returned")).alias("returned"), "known")


class _Cluster:
    """A write and the reads that see it: `first_return` and `last_call` over all of them."""

    __slots__ = ("call", "first_return", "known", "last_call", "reads")

    def __init__(self, call: float, back: float, known: bool):
        self.call, self.first_return, self.last_call, self.known, self.reads = call, back, call, known, 0

    def counts(self) -> bool:
        return self.known or self.reads > 0

    def conflicts(self, other: _Cluster) -> bool:
        """Neither can come whole before the other, as each has an operation that ends before one of the other's begins."""
        return self.last_call > other.first_return and other.last_call > self.first_return


def check_operations(operations: Iterable[dict], initial: str | None = None, max_states: int = MAX_STATES) -> tuple[bool, str, int]:
    """(legal, reason, assignments tried) for the relevant operations of one key.

    Each read is assigned to a write of what it saw; the history is legal if some assignment has no
    read that ends before its write begins and no two clusters in conflict. Only values with several writes
    (deletes all write nothing) leave a choice. A cluster's span only grows, so a conflict ends a branch.
    """
    ops = list(operations)
    if not ops:
        return True, "empty", 0
    writers: dict[str | None, list[_Cluster]] = {initial: [_Cluster(-math.inf, -math.inf, True)]}
    reads = []
    for o in ops:
        if o["op"] == "get":
            reads.append(o)
        else:
            back = o["returned"] if o["known"] else math.inf
            writers.setdefault(o["value"] if o["op"] == "put" else None, []).append(_Cluster(o["invoked"], back, o["known"]))
    every = [c for own in writers.values() for c in own]
    choices = []
    for r in reads:
        fits = [c for c in writers.get(r["result"], []) if c.call <= r["returned"]]
        choices.append((len(fits), r["invoked"], r["returned"], sorted(fits, key=lambda c: -c.call)))
    choices.sort(key=lambda c: c[:3])
    tried, path = 0, []  # per read assigned: (cluster, its span before)
    at, option = 0, 0
    while at < len(choices):
        _, call, back, fits = choices[at]
        if option < len(fits):
            tried += 1
            if tried > max_states:
                return False, UNDECIDED, tried
            c = fits[option]
            path.append((option, c, c.first_return, c.last_call))
            c.first_return, c.last_call, c.reads = min(c.first_return, back), max(c.last_call, call), c.reads + 1
            if not any(c.conflicts(o) for o in every if o is not c and o.counts()):
                at, option = at + 1, 0
                continue
            at += 1  # taken back below
        if not path:
            return False, "no valid linearization", tried
        option, c, c.first_return, c.last_call = path.pop()
        c.reads -= 1
        at, option = at - 1, option + 1
    return True, "linearizable", tried


def _by_clusters(useful: DataFrame) -> DataFrame:
    """Verdicts of keys whose values are written once each: one row per value, compared in the order of time."""
    get = F.col("op") == "get"
    back = F.coalesce("returned", F.lit(math.inf))
    clusters = useful.withColumn("seen", F.when(get, F.col("result")).otherwise(F.col("value"))).groupBy("key", "seen").agg(
        F.min(F.when(~get, F.col("invoked"))).alias("call"), F.min(F.when(get, back)).alias("first_read"), F.min(back).alias("first_return"), F.max("invoked").alias("last_call")
    )
    # What was there before all operations was written at no time.
    before = F.col("seen").isNull()
    clusters = clusters.withColumn("call", F.when(before, -math.inf).otherwise(F.col("call"))).withColumn("first_return", F.when(before, -math.inf).otherwise(F.col("first_return")))
    broken = F.col("call").isNull() | (F.col("first_read") < F.col("call"))
    # Spans (first_return, last_call) must not overlap, and none may hold a whole cluster that has no span.
    span = F.col("first_return") < F.col("last_call")
    earlier = Window.partitionBy("key").orderBy("place", "turn", "seen").rowsBetween(Window.unboundedPreceding, -1)
    ordered = clusters.withColumn("place", F.when(span, F.col("first_return")).otherwise(F.col("last_call"))).withColumn("turn", span.cast("int"))
    reach = F.max(F.when(span, F.col("last_call"))).over(earlier)
    bad = F.coalesce(broken, F.lit(False)) | F.coalesce(reach > F.col("first_return"), F.lit(False))
    return ordered.withColumn("bad", bad).groupBy("key").agg(F.bool_or("bad").alias("bad"), F.count("*").alias("states")).select(
        "key", (~F.col("bad")).alias("ok"), F.when(F.col("bad"), "no valid linearization").otherwise("linearizable").alias("reason"), "states"
    )


def check_history(history: DataFrame, max_states: int = MAX_STATES) -> DataFrame:
    """Verdict of every key: key, ok, reason, states (clusters compared, or assignments tried).

    Keys whose values are each written once are decided by aggregates. The others, with deletes or repeated values, need
    a search, for which one key's history must be in one place; it is the unit of the verdict.
    """

    def verdict(table: pa.Table) -> pa.Table:
        ok, reason, states = check_operations(table.to_pylist(), max_states=max_states)
        return pa.table({"key": [table.column("key")[0].as_py()], "ok": [ok], "reason": [reason], "states": pa.array([states], pa.int64())})

    useful = relevant(history)
    writes = useful.filter("op != 'get'").groupBy("key", "op", "value").agg(F.count("*").alias("n"))
    several = writes.filter("op = 'del' or n > 1").select("key").distinct()
    searched = useful.join(several, "key", "left_semi").groupBy("key").applyInArrow(verdict, "key string, ok boolean, reason string, states long")
    found = _by_clusters(useful.join(several, "key", "left_anti")).unionByName(searched)
    return history.select("key").distinct().join(found, "key", "left").select(
        "key", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("reason", F.lit("empty")).alias("reason"), F.coalesce("states", F.lit(0).cast("long")).alias("states")
    )
