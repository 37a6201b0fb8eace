"""Order-preserving key encodings and checksums as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_of(value: Column) -> Column:
    """Big-endian 8 bytes of a 64-bit integer."""
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def encode_int(value: Column) -> Column:
    """Bytes whose unsigned order is the integers' order: the sign bit is flipped."""
    return bytes_of(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def decode_int(data: Column) -> Column:
    return F.conv(F.hex(data), 16, -10).cast("decimal(20,0)").cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def encode_text(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def inverted(ts: Column) -> Column:
    """Bytes that sort newer timestamps first."""
    return bytes_of(F.bitwise_not(ts.cast("long")))


def row_key(table_id: Column | int, key: Column) -> Column:
    """Key of a table's row: 't', table number, 'r', encoded primary key."""
    number = table_id if isinstance(table_id, Column) else F.lit(table_id)
    return F.concat(F.encode(F.lit("t"), "UTF-8"), F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), F.encode(F.lit("r"), "UTF-8"), key)


def escape(key: Column) -> Column:
    """Prefix-free form that keeps order: every 00 byte becomes 00FF, and 0001 ends it.

    Hex digits are taken in pairs, so only aligned zero bytes are rewritten.
    """
    pairs = F.regexp_replace(F.hex(key), "(..)", "$1,")
    return F.unhex(F.concat(F.replace(F.replace(pairs, F.lit("00,"), F.lit("00FF,")), F.lit(","), F.lit("")), F.lit("0001")))


def unescape(data: Column) -> Column:
    """The key of an escaped one; null if it has no terminator at its end."""
    pairs = F.regexp_replace(F.hex(data), "(..)", "$1,")
    body = F.regexp_replace(pairs, "00,01,$", "")
    clean = F.replace(F.replace(body, F.lit("00,FF,"), F.lit("00,")), F.lit(","), F.lit(""))
    return F.when(pairs.rlike("00,01,$"), F.unhex(clean))


def record_key(column: str, key: Column, ts: Column | None = None) -> Column:
    """Key of a lock (`l`, no time), write (`w`) or data (`d`) record."""
    parts = [F.encode(F.lit(f"!{column}"), "UTF-8"), escape(key)]
    return F.concat(*parts, *([inverted(ts)] if ts is not None else []))


def crc32(data: Column) -> Column:
    """IEEE CRC-32, unsigned."""
    return F.crc32(data)


def value_text(value: Column) -> Column:
    return value.cast("string")


def bounds_text(start: Column, end: Column) -> Column:
    """`[a, b)`; an open end shows as nothing."""
    return F.concat(F.lit("["), F.decode(start, "UTF-8"), F.lit(", "), F.decode(end, "UTF-8"), F.lit(")"))


# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def fnv1a_64(key: Column) -> Column:
    """Exact 64-bit FNV-1a; Parquet's own bloom filters serve scans, this is for stored hashes."""

    def hashes(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in keys:
            yield s.map(lambda k: Decimal(fnv1a(bytes(k))))

    return F.pandas_udf(hashes, "decimal(20,0)")(key)
