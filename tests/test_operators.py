import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import InvalidArgument
from palimpsest.functions import codec
from palimpsest.operators import kv, linear, percolator, quorum, ranges, versions
from palimpsest.sources import history
from palimpsest.streaming import apply

LOCK = "key string, start_ts long, op int, wall_ms long, primary_key string"
WRITE = "key string, commit_ts long, kind int, start_ts long"
DATA = "key string, start_ts long, value string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark):
    log = spark.createDataFrame([("k", s, 1, f"v{s}") for s in range(1, 51)] + [("gone", 1, 1, "x"), ("gone", 9, 2, None)], "key string, seqno long, op int, value string")
    assert rows(versions.visible(log).select("key", "value")) == [("k", "v50")]
    assert rows(versions.as_of(log, 8, ["key"], "seqno").select("key", "value")) == [("gone", "x"), ("k", "v8")]
    deeper = spark.createDataFrame([("a", "h")], "smallest string, largest string")
    assert rows(versions.compact(log, deeper).select("key", "op")) == [("gone", 2), ("k", 1)]
    assert rows(versions.compact(log, None).select("key", "op")) == [("k", 1)]
    assert [tuple(r)[:2] for r in versions.entry_order(log).limit(2).collect()] == [("gone", 9), ("gone", 1)]


def test_transaction_reads(spark):
    writes = spark.createDataFrame([("k", 11, 1, 10), ("k", 21, 1, 20), ("d", 11, 1, 10), ("d", 21, 2, 20), ("r", 30, 3, 30)], WRITE)
    data = spark.createDataFrame([("k", 10, "old"), ("k", 20, "new"), ("d", 10, "x")], DATA)
    none = spark.createDataFrame([], LOCK)
    keys = spark.createDataFrame([("k",), ("d",), ("r",)], "key string")

    def at(ts, locks=none):
        return {r.key: (r.status, r.value) for r in percolator.get(locks, writes, data, keys, ts).collect()}

    assert at(10) == {"k": ("not found", None), "d": ("not found", None), "r": ("not found", None)}
    assert at(15)["k"] == ("ok", "old") and at(15)["d"] == ("ok", "x")
    assert at(100) == {"k": ("ok", "new"), "d": ("not found", None), "r": ("not found", None)}
    lock = spark.createDataFrame([("k", 30, 1, 0, "k")], LOCK)
    assert at(25, lock)["k"] == ("ok", "new") and at(35, lock)["k"] == ("locked", None)
    assert rows(percolator.scan(writes, data, "a", "", 15)) == [("d", "x"), ("k", "old")]
    assert percolator.blocking_lock(lock, "a", "", 35).first().key == "k"
    assert percolator.blocking_lock(lock, "a", "", 25).first() is None


def test_transaction_outcomes(spark):
    locks = spark.createDataFrame([("mine", 10, 1, 1000, "mine"), ("other", 7, 2, 1000, "other")], LOCK)
    writes = spark.createDataFrame([("done", 20, 1, 10), ("newer", 15, 1, 14), ("back", 10, 3, 10)], WRITE)
    requests = spark.createDataFrame([(k, 10) for k in ("mine", "other", "done", "newer", "back", "free")], "key string, start_ts long")
    found = {r.key: r.outcome for r in percolator.prewrite(locks, writes, requests).collect()}
    assert found == {"mine": "replay", "other": "conflict", "done": "conflict", "newer": "conflict", "back": "aborted", "free": "locked"}
    found = {r.key: r.outcome for r in percolator.commit(locks, writes, requests.withColumn("commit_ts", F.lit(12))).collect()}
    assert found == {"mine": "committed", "other": "aborted", "done": "replay", "newer": "aborted", "back": "aborted", "free": "aborted"}
    found = {r.key: r.outcome for r in percolator.rollback(locks, writes, requests).collect()}
    assert found == {"mine": "rolled back", "other": "rolled back", "done": "conflict", "newer": "rolled back", "back": "replay", "free": "rolled back"}
    for now, fate in ((3999, "alive"), (4000, "rolled back")):
        found = {r.key: (r.fate, r.commit_ts, r.writes_marker) for r in percolator.resolve(locks, writes, requests, now).collect()}
        assert found["mine"][0] == fate and found["done"] == ("committed", 20, False) and found["back"] == ("rolled back", 0, False) and found["free"] == ("rolled back", 0, True)
    data = spark.createDataFrame([("mine", 10, "v")], DATA)
    left, marks, kept = percolator.apply_rollbacks(locks, writes, data, percolator.rollback(locks, writes, requests))
    assert [r.key for r in left.collect()] == ["other"] and kept.count() == 0 and marks.filter("kind = 3").count() == 5
    left, done = percolator.apply_commits(locks, writes, percolator.commit(locks, writes, requests.withColumn("commit_ts", F.lit(12))))
    assert [r.key for r in left.collect()] == ["other"] and ("mine", 12, 1, 10) in rows(done)


def test_codecs(spark):
    numbers = sorted({sign * (1 << bit) + step for bit in range(0, 63, 7) for sign in (1, -1) for step in (-1, 0, 1)} | {-(2**63), 2**63 - 1})
    df = spark.createDataFrame([(n,) for n in numbers], "v long").select("v", codec.encode_int(F.col("v")).alias("e"), codec.inverted(F.col("v")).alias("i"))
    assert [r.v for r in df.orderBy("e").collect()] == numbers
    assert [r.v for r in df.filter("v >= 0").orderBy("i").collect()] == sorted((n for n in numbers if n >= 0), reverse=True)
    assert rows(df.select(codec.decode_int(F.col("e")))) == [(n,) for n in numbers]
    keys = [bytes(k) for n in range(4) for k in itertools.product([0, 1, 255], repeat=n)]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select("k", codec.escape(F.col("k")).alias("e"))
    assert [bytes(r.k) for r in df.orderBy("e").collect()] == sorted(keys)
    assert all(bytes(r.k) == bytes(r.u) for r in df.select("k", codec.unescape(F.col("e")).alias("u")).collect())
    check = spark.range(1).select(codec.crc32(F.lit(b"123456789")).alias("c"), codec.fnv1a_64(F.lit(b"a")).alias("f")).first()
    assert check.c == 0xCBF43926 and int(check.f) == 0xAF63DC4C8601EC8C


def test_ranges(spark):
    found = ranges.whole(spark)
    for key in (b"fox", b"owl", b"hen"):
        found = ranges.split(found, key)
    assert [r.bounds for r in ranges.described(found).collect()] == ["[, fox)", "[fox, hen)", "[hen, owl)", "[owl, )"]
    for key in (b"fox", b"owl"):
        with pytest.raises(InvalidArgument, match="split key not strictly inside range"):
            ranges.split(found, key)
    animals = [b"ape", b"bat", b"cat", b"dog", b"elk", b"fox", b"gnu", b"hen", b"ibex", b"owl", b"pig"]
    keys = spark.createDataFrame([(bytearray(k),) for k in animals], "key binary")
    small, large = ranges.route(keys, found), ranges.route(keys, found, most_broadcast=0)
    ids = {bytes(r.start): r.id for r in found.collect()}
    assert dict(rows(small.groupBy("range_id").count())) == {ids[b""]: 5, ids[b"fox"]: 2, ids[b"hen"]: 2, ids[b"owl"]: 2}
    assert rows(small) == rows(large)
    pairs = keys.withColumn("value", F.lit(b"x"))
    assert [bytes(r.key) for r in kv.scan(pairs, b"c", b"fox").collect()] == [b"cat", b"dog", b"elk"]
    assert ranges.owned(pairs, b"hen", b"owl").count() == 2
    assert ranges.restored(pairs, pairs.limit(0), b"hen", b"owl").count() == 9


def test_quorum(spark):
    matches = spark.createDataFrame([("g", n, i, 3) for n, i in enumerate([9, 4, 7, 2, 5])] + [("h", n, 5, 3) for n in range(3)], "grp string, node int, match_index long, current_term long")
    log = spark.createDataFrame([("g", i, 3 if i > 3 else 2) for i in range(1, 10)] + [("h", i, 2) for i in range(1, 6)], "grp string, idx long, term long")
    assert rows(quorum.commit_index(matches, log)) == [("g", 5), ("h", 0)]


def workload(seed, n, keys=1, deletes=0.15, lies=0.3):
    """A seeded history of put, get and del with unique values: most reads are right, some outcomes unknown."""
    draw, now, state, out = random.Random(seed), 0.0, {}, []
    for i in range(n):
        key = f"key{draw.randrange(keys)}"
        kind = draw.choices(["put", "get", "del"], [0.5, 0.5 - deletes, deletes])[0]
        now += draw.choice([0.0, 1.0, 2.0])
        back = now + draw.choice([0.0, 1.0, 3.0, 6.0])
        known = draw.random() < 0.8
        result = None
        if kind == "get":
            result = draw.choice([None, f"w{draw.randrange(n)}", state.get(key)]) if draw.random() < lies else state.get(key)
        elif known or draw.random() < 0.5:
            state[key] = f"w{i}" if kind == "put" else None
        outcome = ("ok" if kind != "get" or result is not None else "notfound") if known else draw.choice(["timeout", None])
        out.append(
            {"id": i, "worker": i % 3, "op": kind, "key": key, "value": f"w{i}" if kind == "put" else None, "invoked": now, "outcome": outcome, "result": result, "returned": back if known else None}
        )
    return out


def every_order(ops):
    """Whether any order of any choice of the unknown operations is a legal run: tries them all."""
    known = [o for o in ops if o["outcome"] in ("ok", "notfound")]
    unknown = [o for o in ops if o["outcome"] not in ("ok", "notfound") and o["op"] != "get"]
    for size in range(len(unknown) + 1):
        for chosen in itertools.combinations(unknown, size):
            for order in itertools.permutations([*known, *chosen]):
                if any(late["returned"] is not None and late["returned"] < early["invoked"] for early, late in itertools.combinations(order, 2)):
                    continue
                value = None
                for o in order:
                    if o["op"] == "get" and o["result"] != value:
                        break
                    value = value if o["op"] == "get" else o["value"]
                else:
                    return True
    return False


HISTORY = "id long, worker long, op string, key string, value string, invoked double, outcome string, result string, returned double"


def test_verdicts_against_every_order(spark):
    histories = {f"h{seed}": workload(seed, 3 + seed % 4, deletes=0.0 if seed % 2 else 0.25) for seed in range(400)}
    raw = [o | {"key": name} for name, ops in histories.items() for o in ops]
    found = {r.key: r.ok for r in linear.check_history(spark.createDataFrame(raw, HISTORY)).collect()}
    want = {name: every_order(ops) for name, ops in histories.items()}
    assert found == want and 40 < sum(want.values()) < 360


def test_verdicts_by_both_ways_agree(spark):
    raw = [o | {"key": f"{seed}"} for seed in range(60) for o in workload(1000 + seed, 60, deletes=0.0, lies=0.02)]
    useful = {}
    for r in linear.relevant(spark.createDataFrame(raw, HISTORY)).collect():
        useful.setdefault(r.key, []).append(r.asDict())
    found = {r.key: r.ok for r in linear.check_history(spark.createDataFrame(raw, HISTORY)).collect()}
    assert all(found[k] == linear.check_operations(ops)[0] for k, ops in useful.items()) and len(set(found.values())) == 2


def test_search_is_bounded():
    wipes = [{"op": "del", "value": None, "result": None, "invoked": float(i), "returned": 90.0 + i, "known": True} for i in range(8)]
    looks = [{"op": "get", "value": None, "result": None, "invoked": float(i), "returned": 95.0 + i, "known": True} for i in range(8)]
    late = [{"op": "put", "value": "x", "result": None, "invoked": 200.0, "returned": 201.0, "known": True}, {"op": "get", "value": None, "result": None, "invoked": 300.0, "returned": 301.0, "known": True}]
    assert linear.check_operations([*wipes, *looks])[0]
    assert not linear.check_operations([*wipes, *looks, *late])[0]
    assert linear.check_operations([*wipes, *looks, *late], max_states=3)[1] == linear.UNDECIDED
    assert linear.check_operations([]) == (True, "empty", 0)


def test_history_file(spark, tmp_path):
    events = [
        {"id": 1, "phase": "invoke", "worker": 0, "op": "put", "key": "a", "value": "x", "invoked": 1.0},
        {"id": 2, "phase": "invoke", "worker": 1, "op": "get", "key": "a", "invoked": 2.0},
        {"id": 1, "phase": "complete", "outcome": "ok", "returned": 3.0},
    ]
    (tmp_path / "h.jsonl").write_text("\n".join(map(json.dumps, events)))
    found = {r.id: (r.outcome, r.returned, r.value) for r in history.read(spark, f"file://{tmp_path}/h.jsonl").collect()}
    assert found == {1: ("ok", 3.0, "x"), 2: (None, None, None)}


def test_stream_is_applied_once(spark, tmp_path):
    schema = "key string, seqno long, op int, value string"
    source, sink, marks = (f"file://{tmp_path}/{x}" for x in ("in", "out", "marks"))
    spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 1, "y")], schema).write.parquet(source)
    apply.apply_stream(spark, source, schema, sink, marks).awaitTermination()
    spark.createDataFrame([("a", 3, 2, None), ("b", 4, 1, "z")], schema).write.mode("append").parquet(source)
    for _ in range(2):
        apply.apply_stream(spark, source, schema, sink, marks).awaitTermination()
    assert rows(apply.applied(spark, sink).select("key", "value")) == [("b", "z")]
    assert rows(apply.applied(spark, sink, 2).select("key", "value")) == [("a", "x"), ("b", "y")]
