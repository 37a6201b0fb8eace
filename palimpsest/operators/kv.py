"""Raw key-value reads over the newest versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import InvalidArgument
from palimpsest.operators.ranges import reserved
from palimpsest.operators.versions import in_range

DEFAULT_LIMIT = 1000


def check_key(key: bytes) -> None:
    if key[:1] in (b"\0", b"!"):
        raise InvalidArgument("reserved key")


def get(pairs: DataFrame, key: bytes) -> DataFrame:
    """The pair of one key, or no row."""
    check_key(key)
    return pairs.filter(F.col("key") == F.lit(bytearray(key)))


def scan(pairs: DataFrame, start: bytes = b"", end: bytes = b"", limit: int = 0) -> DataFrame:
    """Pairs of [start, end) in key order, reserved keys hidden; limit 0 means 1000."""
    near = in_range("key", F.lit(bytearray(start)), F.lit(bytearray(end)))
    return pairs.filter(near & ~reserved(F.col("key"))).orderBy("key").limit(limit or DEFAULT_LIMIT)
