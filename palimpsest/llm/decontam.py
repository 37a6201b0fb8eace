"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are put in partitions by their number of five-word shingles (up to 4,
8, 16, ...). Items of the first partition are looked up by each of their shingles, which misses none.
For each other partition that has items, a document is covered by windows
of two blocks of the partition's size, one block apart, so an item that is copied
lies whole in some window whose size is near its own, however long the document:
containment of 0.8 is then a Jaccard similarity of 0.1 at least with the window. A window
is a candidate for an item if any of `perms` MinHash values agree (64 values miss
a full-size item with chance under 2e-6). Windows test their values against a
Bloom filter of the items' values, which has a fixed size; what passes is joined
by a shuffle, so the benchmark may be of any size. Candidates are verified
by exact containment: the item's distinct shingles that occur anywhere in the document.

Defined cases: null and empty texts match nothing; a text of one to four words has
one shingle of them all, so such an item matches only documents of just these words;
texts of any length are searched whole; items held in equal shares each have their pair; repeated rows and repeated items each give their pairs; null ids are kept; empty
tables give no pairs; other columns are passed by `clean` and ignored by `search`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import give_back, written
from palimpsest.llm.shingles import Permutations, blocks, distinct, mix, shingle_hashes

SMALLEST = 4
FILTER_BITS = 24  # 2 MB


def size_class(n: int) -> int:
    """The least c with n <= SMALLEST * 2**c."""
    return max(0, (max(n, 1) - 1).bit_length() - (SMALLEST - 1).bit_length())


def _value_keys(minima: np.ndarray, classes: np.ndarray | int) -> np.ndarray:
    """A 64-bit key of (size class, MinHash function, value)."""
    place = np.asarray(classes, dtype=np.uint64).reshape(-1, 1) * np.uint64(minima.shape[1]) + np.arange(minima.shape[1], dtype=np.uint64)
    return mix(minima.astype(np.uint64) | (place + np.uint64(1)) << np.uint64(32))


def _shingle_keys(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))


class Bloom:
    """Two-probe filter of fixed size over 64-bit keys."""

    def __init__(self, bits: bytes | None = None):
        self.bits = np.frombuffer(bits, np.uint8) if bits else np.zeros(1 << (FILTER_BITS - 3), np.uint8)

    @staticmethod
    def _at(keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64(probe * FILTER_BITS)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for p in (0, 1):
            at = self._at(keys, p)
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of the keys that may be in the filter."""
        at = self._at(keys, 0)
        found = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        at = self._at(keys[found], 1)
        return found[((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]


def _items(batches: Iterator[pa.RecordBatch], n: int, perms: int) -> Iterator[pa.RecordBatch]:
    hashing = Permutations(perms)
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        for lo, hi in blocks(texts):
            sets, bounds = distinct(*shingle_hashes(texts[lo:hi], n))
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            classes = np.array([size_class(int(s)) for s in sizes[full]], dtype=np.int64)
            keys = _value_keys(hashing.minima(sets, bounds[:-1][full]), classes).view(np.int64)
            # Short items have their shingles for keys: a window would hold many others.
            keys = [_shingle_keys(sets[bounds[i] : bounds[i + 1]]).view(np.int64) if c == 0 else k for i, c, k in zip(full.tolist(), classes.tolist(), keys, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": batch.column("item_id").slice(lo, hi - lo).take(pa.array(full)),
                    "size_class": pa.array(classes, pa.int32()),
                    "shingles": pa.array([sets[bounds[i] : bounds[i + 1]].view(np.int64) for i in full], pa.list_(pa.int64())),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values, shingles = Bloom(), Bloom()
    for batch in batches:
        values.add(np.asarray(batch.column("keys").flatten()).view(np.uint64))
        shingles.add(np.asarray(batch.column("shingles").flatten()).view(np.uint64))
    yield pa.RecordBatch.from_pydict({"filters": pa.array([zlib.compress(values.bits.tobytes() + shingles.bits.tobytes(), 1)], pa.binary())})


def _starts(bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of `step` within each text, and the bounds of each text's runs."""
    counts = -(-np.diff(bounds) // step)
    out = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out[-1]) - np.repeat(out[:-1], counts)
    return np.repeat(bounds[:-1], counts) + at * step, out


def _windows(hashes: np.ndarray, bounds: np.ndarray, classes: list[int], hashing: Permutations) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, minima of its windows, text of each) from the smallest class up."""
    if not classes:
        return
    held = classes[0]
    starts, runs = _starts(bounds, SMALLEST << held)
    minima = hashing.minima(hashes, starts)
    for c in classes:
        if c > held:
            starts, merged = _starts(runs, 1 << (c - held))
            minima, runs, held = np.minimum.reduceat(minima, starts, axis=0) if len(starts) else minima[:0], merged, c
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(runs))
        window = minima.copy()
        pairs = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
        window[pairs] = np.minimum(minima[pairs], minima[pairs + 1])
        yield c, window, text


def _search(batches: Iterator[pa.RecordBatch], filters, classes: list[int], n: int, perms: int) -> Iterator[pa.RecordBatch]:
    data = filters.value
    values, shingles = Bloom(data[: len(data) // 2]), Bloom(data[len(data) // 2 :])
    hashing = Permutations(perms)
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        for lo, hi in blocks(texts):
            hashes, bounds = shingle_hashes(texts[lo:hi], n)
            hits: dict[int, list[int]] = {}
            if classes[0] == 0:
                keys = _shingle_keys(hashes)
                at = values.holds(keys)
                for text, key in zip((np.searchsorted(bounds, at, side="right") - 1).tolist(), keys[at].view(np.int64).tolist(), strict=True):
                    hits.setdefault(text, []).append(key)
            for c, window, text in _windows(hashes, bounds, [c for c in classes if c], hashing):
                keys = _value_keys(window, c).ravel()
                for at in values.holds(keys).tolist():
                    hits.setdefault(int(text[at // perms]), []).append(int(keys[at].view(np.int64)))
            if not hits:
                continue
            found = sorted(hits)
            shared = [np.unique(own[shingles.holds(own)]).view(np.int64) for own in (hashes[bounds[i] : bounds[i + 1]] for i in found)]
            rows = pa.array([lo + i for i in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array([sorted(set(hits[i])) for i in found], pa.list_(pa.int64())), pa.array(shared, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "keys", "shingles"],
            )
    give_back()


def _pairs(docs: DataFrame, benchmark: DataFrame, threshold: float, n: int, perms: int) -> DataFrame:
    spark = docs.sparkSession
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    items = benchmark.select("item_id", "text").mapInArrow(lambda b: _items(b, n, perms), f"item_id {item_kind}, size_class int, shingles array<long>, keys array<long>")
    items = written(items.withColumn("item", F.expr("uuid()")), "items")
    classes = sorted(r[0] for r in items.select("size_class").distinct().collect())
    empty = spark.createDataFrame([], f"doc_id {kind}, text_key string, item_id {item_kind}, n_shared long, n_item long, containment double")
    if not classes:
        return empty
    bits = np.zeros(1 << (FILTER_BITS - 2), np.uint8)
    for row in items.mapInArrow(_filters, "filters binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row.filters), np.uint8)
    filters = spark.sparkContext.broadcast(bits.tobytes())
    given = docs.select("doc_id", F.md5("text").alias("text_key"), "text").filter("text is not null")
    found = given.mapInArrow(lambda b: _search(b, filters, classes, n, perms), f"doc_id {kind}, text_key string, keys array<long>, shingles array<long>")
    found = written(found.withColumn("row", F.expr("uuid()")), "found")
    index = items.select("item", F.explode("keys").alias("key")).distinct()
    candidates = found.select("row", F.explode("keys").alias("key")).join(index, "key").select("row", "item").distinct()
    both = candidates.join(found.select("row", "doc_id", "text_key", F.col("shingles").alias("own")), "row").join(items.select("item", "item_id", "shingles"), "item")
    counted = both.select(
        "doc_id", "text_key", "item_id", F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_item")
    )
    counted = counted.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return counted.filter(F.col("containment") >= threshold - 1e-12)


def search(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5, perms: int = 64) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_item, containment) of items held by documents."""
    return _pairs(docs, benchmark, threshold, n, perms).drop("text_key")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5, perms: int = 64) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    held = _pairs(docs, benchmark, threshold, n, perms).select(F.col("doc_id").alias("held_id"), "text_key").distinct()
    same = docs["doc_id"].eqNullSafe(held.held_id) & (F.md5(docs["text"]) == held.text_key)
    return docs.join(held, same, "left_anti")
