"""Query catalogue: every operator over the driver's tables, with the same query in SQL.

Keys are those of `queries()`; SQL runs on views of the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.functions import codec
from palimpsest.operators import kv, linear, percolator, quorum, ranges, versions
from palimpsest.sources import history
from palimpsest.sources.shared import fresh_path
from palimpsest.streaming import apply

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, fresh_path(spark, "engine"))


# 1. SELECT

_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _reader(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _engine(spark)
    engine.attach("nation", _nation(spark, sf_dir), "n_nationkey")
    engine.attach("orders", _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return engine


def _add_select(name: str, sql: str) -> None:
    _query(sql.replace(" FROM nation", f" FROM ({_NATION})").replace(" FROM orders", f" FROM ({_ORDERS})"), name)(lambda spark, sf_dir: _reader(spark, sf_dir).select(sql))


for _name, _sql in {
    "select_star": "SELECT * FROM nation",
    "select_cols": "SELECT n_name, n_nationkey FROM nation",
    "where_int_eq": "SELECT * FROM orders WHERE o_custkey = 77",
    "where_int_ne": "SELECT o_orderkey FROM orders WHERE o_custkey != 77",
    "where_int_lt": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 500",
    "where_int_le": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey <= 500",
    "where_int_gt": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500",
    "where_int_ge": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 500",
    "where_text_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "where_text_ne": "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'",
    "where_text_lt": "SELECT * FROM nation WHERE n_name < 'NATION_15'",
    "where_text_le": "SELECT * FROM nation WHERE n_name <= 'NATION_15'",
    "where_text_gt": "SELECT * FROM nation WHERE n_name > 'NATION_15'",
    "where_text_ge": "SELECT * FROM nation WHERE n_name >= 'NATION_15'",
    "where_and": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderstatus = 'F' AND o_custkey < 900",
    "point_get": "SELECT * FROM orders WHERE o_orderkey = 1234",
    "point_get_residual": "SELECT * FROM orders WHERE o_orderkey = 1234 AND o_orderstatus != 'X'",
    "point_contradiction": "SELECT * FROM orders WHERE o_orderkey = 1 AND o_orderkey = 2",
}.items():
    _add_select(_name, _sql)


# 2. Writes: the table after the statements

def _after(*statements: str, ts: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark)
        engine.load("nation", _nation(spark, sf_dir), "n_nationkey", 1)
        for s in statements:
            engine.execute(s)
        return engine.select("SELECT * FROM nation", ts)

    return run


for _name, _statements, _sql in [
    ("insert_values", ["INSERT INTO nation VALUES (100, 'ATLANTIS', 9), (-5, 'it''s', 9)"], f"{_NATION} UNION ALL VALUES (100, 'ATLANTIS', 9), (-5, 'it''s', 9)"),
    ("insert_column_list", ["INSERT INTO nation (n_name, n_regionkey, n_nationkey) VALUES ('MU', 8, 77)"], f"{_NATION} UNION ALL VALUES (77, 'MU', 8)"),
    ("update_where", ["UPDATE nation SET n_name = 'X', n_regionkey = 7 WHERE n_nationkey >= 10 AND n_nationkey < 15"], f"SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 10 AND 14 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey BETWEEN 10 AND 14 THEN 7 ELSE n_regionkey END AS n_regionkey FROM ({_NATION})"),
    ("update_all", ["UPDATE nation SET n_regionkey = 5"], f"SELECT n_nationkey, n_name, 5::BIGINT AS n_regionkey FROM ({_NATION})"),
    ("delete_where", ["DELETE FROM nation WHERE n_regionkey = 2"], f"SELECT * FROM ({_NATION}) WHERE n_regionkey != 2"),
    ("drop_and_create", ["DROP TABLE nation", "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT)", "INSERT INTO nation VALUES (1, 'one', 1)"], "SELECT 1::BIGINT AS n_nationkey, 'one' AS n_name, 1::BIGINT AS n_regionkey"),
    ("crud_sequence", ["INSERT INTO nation VALUES (200, 'NEW', 1)", "UPDATE nation SET n_name = 'Z' WHERE n_regionkey = 1", "DELETE FROM nation WHERE n_nationkey < 5", "INSERT INTO nation VALUES (3, 'BACK', 4)"], f"SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'Z' ELSE n_name END AS n_name, n_regionkey FROM ({_NATION} UNION ALL VALUES (200, 'NEW', 1)) WHERE n_nationkey >= 5 UNION ALL VALUES (3, 'BACK', 4)"),
]:
    _query(_sql, _name)(_after(*_statements))

_query(_NATION, "time_travel")(_after("UPDATE nation SET n_name = 'gone'", "DELETE FROM nation WHERE n_nationkey > 3", ts=1))


@_query(f"{_NATION} UNION ALL VALUES (300, 'C', 0)")
def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark)
    engine.load("nation", _nation(spark, sf_dir), "n_nationkey", 1)
    engine.execute("INSERT INTO nation VALUES (300, 'A', 0)")
    engine.execute("UPDATE nation SET n_name = 'C' WHERE n_nationkey = 300")
    engine.compact("nation")
    return engine.select("SELECT * FROM nation")


# 3. Snapshots of a version log: events by user

_LOG = "SELECT user_id AS key, event_id AS seqno, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, event_type AS value FROM events"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seqno"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("op"), F.col("event_type").alias("value")
    )


def _as_of(ts: int) -> str:
    return f"SELECT key, seqno, value FROM ({_LOG}) WHERE seqno <= {ts} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1 AND op = 1"


def _at(spark: SparkSession, sf_dir: str, ts: int) -> DataFrame:
    return versions.as_of(_log(spark, sf_dir), ts, ["key"], "seqno").select("key", "seqno", "value")


@_query(" UNION ALL ".join(f"SELECT {t}::BIGINT AS ts, * FROM ({_as_of(t)})" for t in (500, 2500, 7500)))
def as_of_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merged([_at(spark, sf_dir, t).select(F.lit(t).cast("long").alias("ts"), "*") for t in (500, 2500, 7500)])


@_query(f"SELECT * FROM ({_as_of(5000)}) ORDER BY key LIMIT 20")
def as_of_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir, 5000).orderBy("key").limit(20)


@_query(f"SELECT * FROM ({_LOG}) WHERE key = 7 AND seqno <= 5000")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.entry_order(_log(spark, sf_dir).filter("key = 7 and seqno <= 5000"))


@_query(f"SELECT coalesce(a.key, b.key) AS key, a.value AS before, b.value AS after FROM ({_as_of(2500)}) a FULL JOIN ({_as_of(7500)}) b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
def diff_between_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _at(spark, sf_dir, 2500).select("key", F.col("value").alias("before")), _at(spark, sf_dir, 7500).select("key", F.col("value").alias("after"))
    return a.join(b, "key", "full").filter(~F.col("before").eqNullSafe(F.col("after")))


@_query(
    f"WITH s AS ({_as_of(5000)}), b AS (SELECT DISTINCT key, key % 3 AS gone FROM ({_LOG}) WHERE key % 3 != 2) "
    "SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'mine' FROM b WHERE gone = 0"
)
def txn_overlay_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every key is dealt a part by its number: written, deleted, or left alone.
    own = _log(spark, sf_dir).select("key").distinct().select("key", F.lit("mine").alias("value"), F.when(F.col("key") % 3 == 0, 1).when(F.col("key") % 3 == 1, 2).alias("op")).filter("op is not null")
    return versions.overlay(_at(spark, sf_dir, 5000).select("key", "value"), own)


# 4. Transaction records made of events by fixed rules

_WRITES = """SELECT lpad(user_id::VARCHAR, 6, '0') AS key, CASE WHEN event_type = 'signup' THEN event_id * 10 ELSE event_id * 10 + 5 END AS commit_ts,
 CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS kind, event_id * 10 AS start_ts, event_type AS value FROM events WHERE event_id % 3 != 0"""
_LOCKS = """SELECT lpad(user_id::VARCHAR, 6, '0') AS key, event_id * 10 AS start_ts, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, event_id * 100 AS wall_ms
 FROM events WHERE event_id % 3 = 0 AND user_id % 4 != 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
_REQUESTS = "SELECT lpad(user_id::VARCHAR, 6, '0') AS key, event_id * 10 AS start_ts FROM events"
_NEWEST = f"SELECT * FROM ({_WRITES}) WHERE kind != 3 AND commit_ts <= 60000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) = 1"
_STATE = f"""WITH w AS ({_WRITES}), l AS ({_LOCKS}), r AS ({_REQUESTS}),
 o AS (SELECT key, start_ts, max(commit_ts) FILTER (kind != 3) AS committed_ts, max(kind = 3) AS rolled_back FROM w GROUP BY ALL),
 last AS (SELECT key, max(commit_ts) AS last_commit FROM w WHERE kind != 3 GROUP BY key),
 s AS (SELECT r.key, r.start_ts, o.committed_ts, coalesce(o.rolled_back, false) AS rolled_back, l.start_ts AS lock_ts, l.op AS lock_op, l.wall_ms, last.last_commit
       FROM r LEFT JOIN o USING (key, start_ts) LEFT JOIN l ON l.key = r.key LEFT JOIN last ON last.key = r.key) """


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(locks, writes, data, requests)."""
    events = _table(spark, sf_dir, "events").withColumn("key", F.lpad(F.col("user_id").cast("string"), 6, "0")).withColumn("start_ts", F.col("event_id") * 10)
    kind = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "signup", 3).otherwise(1)
    written = events.filter("event_id % 3 != 0").withColumn("kind", kind).withColumn("commit_ts", F.col("start_ts") + F.when(F.col("kind") == 3, 0).otherwise(5))
    writes = written.select("key", "commit_ts", "kind", "start_ts")
    data = written.filter("kind = 1").select("key", "start_ts", F.col("event_type").alias("value"))
    locks = versions.newest(events.filter("event_id % 3 = 0 and user_id % 4 != 0"), ["key"], ["event_id"]).select(
        "key", "start_ts", F.when(F.col("event_type") == "error", 2).otherwise(1).alias("op"), (F.col("event_id") * 100).alias("wall_ms"), F.col("key").alias("primary_key")
    )
    return locks, writes, data, events.select("key", "start_ts")


@_query(
    f"SELECT k.key, CASE WHEN l.key IS NOT NULL THEN 'locked' WHEN n.kind = 1 THEN 'ok' ELSE 'not found' END AS status, CASE WHEN l.key IS NULL AND n.kind = 1 THEN n.value END AS value, l.start_ts AS lock_ts "
    f"FROM (SELECT DISTINCT key FROM ({_WRITES})) k LEFT JOIN (SELECT * FROM ({_LOCKS}) WHERE start_ts <= 60000) l ON l.key = k.key LEFT JOIN ({_NEWEST}) n ON n.key = k.key"
)
def txn_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, data, _ = _records(spark, sf_dir)
    return percolator.get(locks, writes, data, writes.select("key").distinct(), 60000)


@_query(f"SELECT key, value FROM ({_NEWEST}) WHERE kind = 1 AND key >= '000020' AND key < '000090' ORDER BY key LIMIT 30")
def txn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, writes, data, _ = _records(spark, sf_dir)
    return percolator.scan(writes, data, "000020", "000090", 60000, 30)


@_query(f"SELECT key, start_ts FROM ({_LOCKS}) WHERE key >= '000020' AND key < '000090' AND start_ts <= 200000 ORDER BY key LIMIT 1")
def lock_blocked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolator.blocking_lock(_records(spark, sf_dir)[0], "000020", "000090", 200000).select("key", "start_ts")


@_query(f"SELECT key, commit_ts, kind, start_ts FROM ({_WRITES}) WHERE key = '000007' AND commit_ts <= 50000")
def write_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolator.history(_records(spark, sf_dir)[1], "000007", 50000)


@_query(
    f"{_STATE} SELECT key, start_ts, CASE WHEN rolled_back THEN 'aborted' WHEN last_commit >= start_ts THEN 'conflict' WHEN lock_ts IS NOT NULL AND lock_ts != start_ts THEN 'conflict' WHEN lock_ts = start_ts THEN 'replay' ELSE 'locked' END AS outcome, last_commit FROM s"
)
def prewrite_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, _, requests = _records(spark, sf_dir)
    return percolator.prewrite(locks, writes, requests)


@_query(f"{_STATE} SELECT key, start_ts, last_commit FROM s WHERE NOT rolled_back AND last_commit >= start_ts")
def ww_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, _, requests = _records(spark, sf_dir)
    return percolator.prewrite(locks, writes, requests).filter("outcome = 'conflict' and last_commit >= start_ts").select("key", "start_ts", "last_commit")


@_query(
    f"{_STATE} SELECT key, start_ts, start_ts + 3 AS commit_ts, CASE WHEN lock_ts = start_ts THEN 'committed' WHEN committed_ts IS NOT NULL THEN 'replay' ELSE 'aborted' END AS outcome, CASE WHEN lock_ts = start_ts THEN CASE WHEN lock_op = 2 THEN 2 ELSE 1 END END AS kind FROM s"
)
def commit_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, _, requests = _records(spark, sf_dir)
    return percolator.commit(locks, writes, requests.withColumn("commit_ts", F.col("start_ts") + 3))


@_query(f"{_STATE} SELECT key, start_ts, committed_ts AS commit_ts, rolled_back FROM s")
def txn_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, writes, _, requests = _records(spark, sf_dir)
    return percolator.outcome(writes, requests)


@_query(
    f"{_STATE} SELECT key, start_ts, CASE WHEN lock_ts = start_ts AND 600000 < wall_ms + 3000 THEN 'alive' WHEN committed_ts IS NOT NULL THEN 'committed' ELSE 'rolled back' END AS fate, "
    "CASE WHEN lock_ts = start_ts AND 600000 < wall_ms + 3000 THEN NULL ELSE coalesce(committed_ts, 0) END AS commit_ts, NOT coalesce(lock_ts = start_ts AND 600000 < wall_ms + 3000, false) AND committed_ts IS NULL AND NOT rolled_back AS writes_marker FROM s"
)
def resolve_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, _, requests = _records(spark, sf_dir)
    return percolator.resolve(locks, writes, requests, 600000)


@_query(f"{_STATE} SELECT key, commit_ts, kind, start_ts FROM w UNION ALL SELECT key, start_ts, 3, start_ts FROM s WHERE committed_ts IS NULL AND NOT rolled_back")
def rollback_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, data, requests = _records(spark, sf_dir)
    return percolator.apply_rollbacks(locks, writes, data, percolator.rollback(locks, writes, requests))[1]


@_query(f"{_STATE} SELECT l.key, l.start_ts FROM l WHERE (l.key, l.start_ts) NOT IN (SELECT (key, start_ts) FROM s WHERE lock_ts = start_ts)")
def locks_after_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    locks, writes, _, requests = _records(spark, sf_dir)
    done = percolator.commit(locks, writes, requests.withColumn("commit_ts", F.col("start_ts") + 3))
    return percolator.apply_commits(locks, writes, done)[0].select("key", "start_ts")


# 5. Merging and compaction: seven levels of the log

_LEVELS = f"SELECT *, (seqno % 7)::INTEGER AS level FROM ({_LOG})"
_TOP = f"SELECT key, seqno, op, value FROM ({_LEVELS}) WHERE level < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1"


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).withColumn("level", (F.col("seqno") % 7).cast("int"))


@_query(f"SELECT key, seqno, op, value FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1")
def merge_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    return versions.newest(versions.merged([levels.filter(F.col("level") == i) for i in range(7)]), ["key"], ["seqno"]).drop("level")


@_query(f"SELECT * FROM ({_TOP}) WHERE op = 1")
def compact_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.compact(_levels(spark, sf_dir).filter("level < 2").drop("level"), None)


@_query(
    f"WITH m AS (SELECT level, min(key) AS lo, max(key) AS hi FROM ({_LEVELS}) WHERE level >= 5 AND key BETWEEN 20 AND 90 GROUP BY level) SELECT * FROM ({_TOP}) t WHERE op = 1 OR EXISTS (SELECT 1 FROM m WHERE t.key BETWEEN lo AND hi)"
)
def compact_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(spark, sf_dir)
    return versions.compact(levels.filter("level < 2").drop("level"), versions.table_meta(levels.filter("level >= 5 and key between 20 and 90")))


@_query(f"SELECT level, min(key) AS smallest, max(key) AS largest, count(*) AS entries, max(seqno) AS last_seqno FROM ({_LEVELS}) GROUP BY level")
def table_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.table_meta(_levels(spark, sf_dir))


@_query(
    f"SELECT level, count(DISTINCT key) AS files, sum(length(value))::BIGINT * 20000 AS bytes, CASE WHEN level > 0 THEN (8388608 * pow(10, level - 1))::BIGINT END AS target_bytes, "
    f"CASE WHEN level = 0 THEN count(DISTINCT key) >= 4 ELSE sum(length(value)) * 20000 > 8388608 * pow(10, level - 1) END AS due FROM ({_LEVELS}) GROUP BY level"
)
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _levels(spark, sf_dir).groupBy("level").agg(F.count_distinct("key").alias("files"), (F.sum(F.length("value")) * 20000).alias("bytes"))
    return versions.level_limits(stats)


@_query(f"SELECT key, seqno, value FROM ({_LOG}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seqno DESC) = 1 AND op = 1")
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, sink, marks = (fresh_path(spark, f"stream-{x}") for x in ("source", "sink", "marks"))
    log = _log(spark, sf_dir)
    log.repartition(4).write.parquet(source)
    apply.apply_stream(spark, source, log.schema.simpleString()[7:-1].replace(":", " "), sink, marks).awaitTermination()
    return apply.applied(spark, sink).select("key", "seqno", "value")


# 6. Key-value pairs and ranges: parts by padded key

_PAIRS = "SELECT lpad(p_partkey::VARCHAR, 8, '0') AS key, p_name AS value FROM part"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.encode(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), "UTF-8").alias("key"), F.col("p_name").alias("value"))


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("key", F.decode("key", "UTF-8"))


def _split(spark: SparkSession) -> DataFrame:
    found = ranges.whole(spark)
    for key in (b"00000500", b"00001200", b"00000800"):
        found = ranges.split(found, key)
    return found


@_query(f"SELECT * FROM ({_PAIRS}) WHERE key = '00000123'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kv.get(_pairs(spark, sf_dir), b"00000123"))


@_query(f"SELECT * FROM ({_PAIRS}) WHERE key >= '00000100' AND key < '00000200' ORDER BY key LIMIT 30")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kv.scan(_pairs(spark, sf_dir), b"00000100", b"00000200", 30))


@_query(f"SELECT * FROM ({_PAIRS}) ORDER BY key LIMIT 1000")
def kv_scan_default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(kv.scan(_pairs(spark, sf_dir)))


@_query(f"SELECT * FROM ({_PAIRS}) WHERE value NOT LIKE 'a%' ORDER BY key LIMIT 1000")
def kv_reserved_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.concat(F.encode(F.lit("!"), "UTF-8"), F.col("key"))
    return _shown(kv.scan(_pairs(spark, sf_dir).withColumn("key", F.when(F.col("value").startswith("a"), hidden).otherwise(F.col("key")))))


@_query(f"SELECT key, CASE WHEN key < '00000500' THEN 1 WHEN key < '00000800' THEN 2 WHEN key < '00001200' THEN 4 ELSE 3 END AS range_id FROM ({_PAIRS})")
def route_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranges.route(_pairs(spark, sf_dir).select("key"), _split(spark)))


@_query("SELECT * FROM (VALUES (1, '[, 00000500)'), (2, '[00000500, 00000800)'), (4, '[00000800, 00001200)'), (3, '[00001200, )')) t(id, bounds)")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.described(_split(spark))


@_query("SELECT * FROM (VALUES (2, '[00000500, 00000800)'), (4, '[00000800, 00001200)')) t(id, bounds)")
def range_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.described(ranges.intersecting(_split(spark), b"00000600", b"00001200"))


@_query(f"SELECT * FROM ({_PAIRS}) WHERE key >= '00000490' AND key < '00000900' ORDER BY key LIMIT 350")
def cross_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, parts = _pairs(spark, sf_dir), ranges.intersecting(_split(spark), b"00000490", b"00000900").collect()
    return _shown(kv.scan(versions.merged([ranges.owned(pairs, bytes(r.start), bytes(r.end)) for r in parts]), b"00000490", b"00000900", 350))


@_query(f"SELECT * FROM ({_PAIRS}) WHERE key >= '00000500' AND key < '00000800'")
def range_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ranges.owned(_pairs(spark, sf_dir), b"00000500", b"00000800"))


@_query(f"SELECT key, CASE WHEN key >= '00000500' AND key < '00000800' THEN 'restored' ELSE value END AS value FROM ({_PAIRS})")
def range_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    saved = ranges.owned(pairs, b"00000500", b"00000800").withColumn("value", F.lit("restored"))
    return _shown(ranges.restored(pairs, saved, b"00000500", b"00000800"))


# 7. Codecs

_NUMBERS = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 1000003 ELSE -event_id * 777 END AS v FROM events"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 2 == 0, F.col("event_id") * 1000003).otherwise(-F.col("event_id") * 777)
    return _table(spark, sf_dir, "events").select("event_id", v.alias("v"))


def _big_endian(value: str) -> str:
    return f"format('{{:016X}}', ({value})::UBIGINT)"


@_query(f"SELECT event_id, {_big_endian('v::HUGEINT + 9223372036854775808')} AS encoded FROM ({_NUMBERS})")
def pk_encode_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("event_id", F.hex(codec.encode_int(F.col("v"))).alias("encoded"))


@_query(f"SELECT event_id, v FROM ({_NUMBERS})")
def pk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("event_id", codec.decode_int(codec.encode_int(F.col("v"))).alias("v"))


@_query(f"SELECT event_id, {_big_endian('18446744073709551615::HUGEINT - event_id')} AS encoded FROM events")
def inverted_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(spark, sf_dir).select("event_id", F.hex(codec.inverted(F.col("event_id"))).alias("encoded"))


@_query("SELECT o_orderkey, hex(encode(o_orderpriority)) || '00FF' || hex(encode(o_orderstatus)) || '0001' AS escaped, hex(encode(o_orderpriority)) || '00' || hex(encode(o_orderstatus)) AS plain FROM orders")
def escape_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    raw = F.concat(F.encode("o_orderpriority", "UTF-8"), F.unhex(F.lit("00")), F.encode("o_orderstatus", "UTF-8"))
    escaped = codec.escape(raw)
    return orders.select("o_orderkey", F.hex(escaped).alias("escaped"), F.hex(codec.unescape(escaped)).alias("plain"))


@_query("SELECT n_nationkey::BIGINT AS n_nationkey, '740000000772' || hex(encode(n_name)) AS row_key, '2177' || hex(encode(n_name)) || '0001' || 'FFFFFFFFFFFFFFEB' AS write_key FROM nation")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = codec.encode_text(F.col("n_name"))
    return _nation(spark, sf_dir).select("n_nationkey", F.hex(codec.row_key(7, name)).alias("row_key"), F.hex(codec.record_key("w", name, F.lit(20))).alias("write_key"))


@_query()
def crc32_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).select("n_nationkey", codec.crc32(codec.encode_text(F.col("n_name"))).alias("crc"))


@_query()
def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation(spark, sf_dir).select("n_nationkey", codec.fnv1a_64(codec.encode_text(F.col("n_name"))).alias("hash"))


# 8. Histories: purchases write, other events read the last purchase; some reads of keys ending in 3 lie

_HISTORY = """SELECT event_id AS id, user_id % 5 AS worker, user_id::VARCHAR AS key, CASE WHEN event_type = 'purchase' THEN 'put' ELSE 'get' END AS op,
 CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END AS value, event_id::DOUBLE AS invoked,
 CASE WHEN event_id % 17 = 0 AND event_type != 'purchase' THEN 'timeout' ELSE 'ok' END AS outcome, event_id + 0.5::DOUBLE AS returned,
 CASE WHEN event_type != 'purchase' THEN CASE WHEN user_id % 10 = 3 AND event_id % 11 = 0 THEN 'lie' ELSE
   max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id)::VARCHAR END END AS result FROM events"""


def _events_of_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    put = F.col("event_type") == "purchase"
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("worker"), F.col("user_id").cast("string").alias("key"), F.when(put, "put").otherwise("get").alias("op"),
        F.when(put, F.col("event_id").cast("string")).alias("value"), F.col("event_id").cast("double").alias("invoked"),
        F.when((F.col("event_id") % 17 == 0) & ~put, "timeout").otherwise("ok").alias("outcome"), (F.col("event_id") + 0.5).alias("returned"),
        F.when(~put, F.when((F.col("user_id") % 10 == 3) & (F.col("event_id") % 11 == 0), "lie").otherwise(F.max(F.when(put, F.col("event_id"))).over(before).cast("string"))).alias("result"),
    )
    none = F.lit(None)
    invoked = rows.select("id", F.lit("invoke").alias("phase"), "worker", "op", "key", "value", "invoked", none.cast("string").alias("outcome"), none.cast("string").alias("result"), none.cast("double").alias("returned"))
    completed = rows.select("id", F.lit("complete").alias("phase"), "worker", none.cast("string").alias("op"), none.cast("string").alias("key"), none.cast("string").alias("value"), none.cast("double").alias("invoked"), "outcome", "result", "returned")
    return invoked.unionByName(completed.filter("id % 13 != 0"))


_MERGED = f"SELECT id, worker, op, key, value, invoked, CASE WHEN id % 13 != 0 THEN outcome END AS outcome, CASE WHEN id % 13 != 0 THEN result END AS result, CASE WHEN id % 13 != 0 THEN returned END AS returned FROM ({_HISTORY})"
_USEFUL = f"""WITH h AS ({_MERGED}), reads AS (SELECT * FROM h WHERE op = 'get' AND outcome IN ('ok', 'notfound')),
 u AS (SELECT h.*, coalesce(outcome IN ('ok', 'notfound'), false) AS known FROM h) SELECT id, key, op, value, result, invoked, CASE WHEN known THEN returned END AS returned, known FROM u
 WHERE known OR (op = 'put' AND (key, value) IN (SELECT (key, result) FROM reads WHERE result IS NOT NULL))"""


@_query(_MERGED)
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.merge(_events_of_history(spark, sf_dir))


@_query(_USEFUL)
def history_build_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.relevant(history.merge(_events_of_history(spark, sf_dir)))


@_query(f"SELECT key, NOT coalesce(bool_or(op = 'get' AND outcome = 'ok' AND result = 'lie'), false) AS ok FROM ({_MERGED}) GROUP BY key")
def linearizability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.check_history(history.merge(_events_of_history(spark, sf_dir))).select("key", "ok")


# 9. Quorum: five replicas per user have reached their last events

_QUORUM = """WITH m AS (SELECT user_id AS grp, event_id % 5 AS node, max(event_id) AS match_index FROM events GROUP BY ALL),
 t AS (SELECT user_id AS grp, max(event_id // 2000) AS now FROM events GROUP BY ALL),
 r AS (SELECT grp, list_sort(list(match_index), 'DESC')[count(*) // 2 + 1] AS reached FROM m GROUP BY grp)
 SELECT r.grp, coalesce(max(e.event_id), 0) AS commit_index FROM r JOIN t USING (grp) LEFT JOIN events e ON e.user_id = r.grp AND e.event_id <= reached AND e.event_id // 2000 = now GROUP BY r.grp"""


@_query(_QUORUM)
def quorum_commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("idx"), F.floor(F.col("event_id") / 2000).alias("term"))
    terms = events.groupBy("grp").agg(F.max("term").alias("current_term"))
    matches = events.groupBy("grp", (F.col("idx") % 5).alias("node")).agg(F.max("idx").alias("match_index")).join(terms, "grp")
    return quorum.commit_index(matches, events)
