"""Token-ID binary output with Elias-Fano document boundaries.

A store is a set of shard files plus one manifest row per shard. Documents are
range-partitioned and sorted by id, so shard k holds the ids right after shard
k - 1. One shard file, written in a single streaming pass, is

    magic (8 bytes) | ids, little endian, 2 or 4 bytes each | doc ids (int64) |
    doc id validity bits | low bits | high bits | select samples | footer (JSON) |
    footer length (4 bytes) | magic

The boundaries (first id of every document, then the shard's end) are an
Elias-Fano sequence: ``low_bits`` low bits of every value packed, the rest unary
coded in ``high``; the bit position of every 256th one is kept, so ``select`` finds
one boundary by scanning a few bytes and no 64-bit offset table exists.

Defined cases: null text is empty (its document has only the end id); null ids
sort first and stay null; repeated ids are separate documents in any order among
themselves; texts of any length are encoded whole; an empty table has no shard; other columns are ignored;
ids that are not integers are refused.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import filesystem, fresh_path, whole_numbers, written
from palimpsest.llm.tokens import default_tokenizer, encoder, widen

MAGIC = b"PLMPIDS1"
SAMPLE = 256
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(u / n)`` bits a value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, first: int, last: int) -> np.ndarray:
        b = self.low_bits
        if not b:
            return np.zeros(last - first, dtype=np.int64)
        at = np.arange(first * b, last * b)
        bits = (self.low[at >> 3] >> (at & 7)) & 1
        return bits.reshape(-1, b).astype(np.int64) @ (1 << np.arange(b, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and a scan of the bytes between."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        left += int(_ONES[self.high[byte] & ((1 << (at & 7)) - 1)])
        while left >= _ONES[self.high[byte]]:
            left -= int(_ONES[self.high[byte]])
            byte += 1
        place = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left]
        return ((byte * 8 + int(place) - i) << self.low_bits) | int(self._low(i, i + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values first..last - 1, decoded together."""
        if last <= first:
            return np.zeros(0, dtype=np.int64)
        start = int(self.samples[first // SAMPLE])
        stop = int(self.samples[-(-last // SAMPLE)]) if -(-last // SAMPLE) < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[start >> 3 : (stop >> 3) + 1], bitorder="little")
        bits[: start & 7] = 0
        ones = np.flatnonzero(bits) + (start & ~7)
        skip = first % SAMPLE
        high = ones[skip : skip + last - first] - np.arange(first, last)
        return (high << self.low_bits) | self._low(first, last)


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    end = np.array([end_id], dtype=coder.dtype).tobytes()
    width = coder.dtype.itemsize
    fs, base = filesystem(folder)
    out, path, doc_ids, known, lengths = None, "", [], [], []
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            if out is None:
                fs.create_dir(base, recursive=True)
                path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                out = fs.open_output_stream(filesystem(path)[1], compression=None)
                out.write(MAGIC)
            for ids in coder.encode_all(part.column("text").to_pylist()):
                out.write(ids + end)
                lengths.append(len(ids) // width + 1)
            ids = part.column("doc_id")
            known.append(np.asarray(ids.is_valid()))
            doc_ids.append(ids.fill_null(0).to_numpy())
    if out is None:
        return
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64))]))
    sections = {
        "doc_ids": np.concatenate(doc_ids).astype("<i8").tobytes(),
        "known": np.packbits(np.concatenate(known), bitorder="little").tobytes(),
        "low": bounds.low.tobytes(),
        "high": bounds.high.tobytes(),
        "samples": bounds.samples.astype("<u4").tobytes(),
    }
    for data in sections.values():
        out.write(data)
    footer = json.dumps(
        {"n": len(lengths), "n_ids": sum(lengths), "id_bytes": width, "low_bits": bounds.low_bits, "sections": {k: len(v) for k, v in sections.items()}}
    ).encode()
    out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
    out.close()
    yield pa.RecordBatch.from_pydict(
        {"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([sum(lengths)], pa.int64())}
    )


class Shard:
    """One shard file, opened for reading on any executor."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a complete id shard")
        n = int.from_bytes(tail[:4], "little")
        self.meta = json.loads(self.file.read_at(n, size - 12 - n))
        self.n, self.dtype = self.meta["n"], np.dtype(f"<u{self.meta['id_bytes']}")
        at = len(MAGIC) + self.meta["n_ids"] * self.dtype.itemsize
        parts = {}
        for name, length in self.meta["sections"].items():
            parts[name] = self.file.read_at(length, at)
            at += length
        self.doc_ids = np.frombuffer(parts["doc_ids"], dtype="<i8")
        self.known = np.unpackbits(np.frombuffer(parts["known"], dtype=np.uint8), count=self.n, bitorder="little").astype(bool)
        self.bounds = EliasFano(
            self.n + 1, self.meta["low_bits"], np.frombuffer(parts["low"], np.uint8), np.frombuffer(parts["high"], np.uint8), np.frombuffer(parts["samples"], "<u4")
        )

    def ids(self, first: int, last: int) -> bytes:
        """The stored bytes of ids first..last - 1."""
        w = self.dtype.itemsize
        return self.file.read_at((last - first) * w, len(MAGIC) + first * w)

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.ids(self.bounds.select(i), self.bounds.select(i + 1)), dtype=self.dtype)


def _read_shards(batches: Iterator[pa.RecordBatch], block: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"])
            for lo in range(0, shard.n, block):
                hi = min(lo + block, shard.n)
                at = shard.bounds.select_range(lo, hi + 1)
                data = shard.ids(int(at[0]), int(at[-1]))
                w = shard.dtype.itemsize
                crc = [zlib.crc32(widen(data[(a - at[0]) * w : (b - at[0]) * w], shard.dtype.str)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=~shard.known[lo:hi]),
                        "start": pa.array(at[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )


def write_store(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write every document's ids; returns the manifest (shard, path, n_docs, n_ids, base)."""
    spark = docs.sparkSession
    whole_numbers(docs, "doc_id")
    path, folder = tokenizer or default_tokenizer(), fresh_path(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = written(rows.mapInArrow(lambda b: _write_shard(b, folder, path, end_id), "shard int, path string, n_docs long, n_ids long"), "id-manifest")
    # One row per shard; the bases of a hundred thousand shards are a few MB.
    base, out = 0, []
    for r in shards.orderBy("shard").collect():
        out.append((r.shard, r.path, r.n_docs, r.n_ids, base))
        base += r.n_ids
    return spark.createDataFrame(out, "shard int, path string, n_docs long, n_ids long, base long")


def read_store(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start over all shards, n_tokens, ids_crc32."""
    shards = manifest.count()
    dealt = manifest.select("path", "base").repartition(max(1, shards), "path")
    return dealt.mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Round trip: write the store, read it back, one row per document."""
    return read_store(docs.sparkSession, write_store(docs, tokenizer, end_id))
