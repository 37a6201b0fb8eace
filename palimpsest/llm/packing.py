"""Mixture-controlled packing of documents into fixed windows.

Every source is a queue; the ids of its documents, in file order, are one tape.
Each window draws from every queue its share of ``length`` ids by deficit
round-robin: a queue's credit grows by its quantum per window, the whole part is
drawn, and what rounding leaves goes to the largest deficits. A queue's deficit
(credit less ids drawn) is thus always under one id and has a closed form, so any
partition knows the exact deficits at the window it starts with and no state has
to be passed from task to task. When a queue runs out, one window is filled from
what is left and the shares are renewed over the others. The last ids, fewer than
a window, go to sequences of falling powers of two, which need no padding.

Sources with a share under two ids a window and no target share one queue, so there
are at most ``length / 2`` queues, and those of named sources, however many sources
exist. The shared tape is dealt id by id over a tree of its sources (Huffman's, in
hash buckets): at each node the first n ids are split by rounding n times the left
share, so each source keeps its share all along, at 0.5 ids a window one id about
every second window. Where an id lies on the tape follows from its source's way to
the root alone. Queues under one id a window are split off a group in the same way.
Deficits inside a tree are under three ids.

Defined cases: null text is empty; null source is a source of its own; repeated
rows are packed as often as they come; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.shared import give_back, written
from palimpsest.llm.tokens import default_tokenizer, encoder

_ONE = 1 << 32
#: The shared queue's sources are dealt by hash; each bucket makes its part of the tree.
_BUCKETS = 1024


def _scaled(m: np.ndarray, t: int, c: int, d: int) -> np.ndarray:
    """floor((m * t + c) / d), exact: products wrap at 64 bits, but the estimate's remainder is small."""
    q = np.floor(m * (t / d)).astype(np.int64)
    return q + (m * np.int64(t) + np.int64(c) - q * np.int64(d)) // d


def _ways(sizes: list[int]) -> list[list[int]]:
    """Each leaf's way up a Huffman tree: the sizes of the nodes above, negative where it comes from the right."""
    heap = [(n, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    for node in range(len(sizes), 2 * len(sizes) - 1):
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        above[left], above[right] = (node, a + b), (node, -a - b)
        heapq.heappush(heap, (a + b, node))
    out = []
    for leaf in range(len(sizes)):
        way, node = [], leaf
        while node in above:
            node, size = above[node]
            way.append(size)
        out.append(way)
    return out


def _climb(at: np.ndarray, size: int, way: list[int]) -> np.ndarray:
    """Positions on the shared tape of a source's ids `at`."""
    for t in way:
        at, size = _scaled(2 * at + 1, abs(t), -1 if t > 0 else 0, 2 * size), abs(t)
    return at


class Schedule:
    """How many ids each window takes from each queue, for any window at once."""

    def __init__(self, totals: list[int], weights: list[float], length: int):
        self.length = length
        self._groups: dict[bytes, tuple[np.ndarray, list[list[int]]]] = {}
        left = np.array(totals, dtype=np.int64)
        share = np.array(weights, dtype=np.float64)
        self.first: list[int] = []  # first window of each phase
        self.base: list[np.ndarray] = []  # ids drawn from each queue before it
        self.quanta: list[np.ndarray | None] = []  # fixed point, sum 2**32; None: one window of explicit takes
        done, window = np.zeros_like(left), 0

        def add(takes: np.ndarray | None, quanta: np.ndarray | None, windows: int, drawn: np.ndarray) -> None:
            nonlocal done, window, left
            self.first.append(window)
            self.base.append(done.copy())
            self.quanta.append(quanta)
            done, left, window = done + drawn, left - drawn, window + windows

        while left.sum() >= length:
            quanta = self._quanta(np.where(left > 0, share, 0.0))
            lo, hi = 0, int(left.sum()) // length
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if (self.drawn(quanta, np.array([mid]))[0] <= left).all() else (lo, mid - 1)
            if lo:
                add(None, quanta, lo, self.drawn(quanta, np.array([lo]))[0])
            if left.sum() >= length:
                take = np.minimum(self.drawn(quanta, np.array([lo + 1]))[0] - self.drawn(quanta, np.array([lo]))[0], left)
                for q in np.argsort(-(left - take), kind="stable"):
                    take[q] += min(int(left[q] - take[q]), length - int(take.sum()))
                add(take, None, 1, take)
        while (rest := int(left.sum())) > 0:
            size, take = 1 << (rest.bit_length() - 1), np.zeros_like(left)
            for q in range(len(left)):
                take[q] = min(int(left[q]), size - int(take.sum()))
            add(take, None, 1, take)
        self.first.append(window)
        self.base.append(done.copy())
        self.bases = np.array(self.base)
        #: Queues that somewhere draw less than one id a window.
        self.thin = {q for quanta in self.quanta if quanta is not None for q in np.flatnonzero((quanta > 0) & (quanta * length < _ONE)).tolist()}

    @staticmethod
    def _quanta(share: np.ndarray) -> np.ndarray:
        exact = share / share.sum() * _ONE
        out = np.floor(exact).astype(np.int64)
        out[np.argsort(-np.where(share > 0, exact - out, -1), kind="stable")[: _ONE - int(out.sum())]] += 1
        return out

    def _group(self, quanta: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Queues under one id a window, with the next smallest until all draw two; their ways up a tree."""
        if (key := quanta.tobytes()) not in self._groups:
            order = np.argsort(quanta, kind="stable")
            order = order[quanta[order] > 0]
            rates = np.cumsum(quanta[order] * self.length)
            n = int((quanta[order] * self.length < _ONE).sum())
            members = order[: max(n, int(np.searchsorted(rates, 2 * _ONE)) + 1)] if n else order[:0]
            self._groups[key] = members, _ways(quanta[members].tolist())
        return self._groups[key]

    def drawn(self, quanta: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Ids drawn from each queue in the first `windows` windows of a phase; exact integers."""
        members, ways = self._group(quanta)
        if not len(members):
            return self._rounded(quanta, windows)
        top = quanta.copy()
        top[members] = 0
        out = self._rounded(np.append(top, quanta[members].sum()), windows)
        for q, way in zip(members.tolist(), ways, strict=True):
            nodes = [int(quanta[q]), *map(abs, way)]
            n = out[:, -1]
            for k in range(len(way) - 1, -1, -1):
                whole, part = nodes[k + 1], nodes[k]
                n = _scaled(n, 2 * part, whole, 2 * whole) if way[k] > 0 else n - _scaled(n, 2 * (whole - part), whole, 2 * whole)
            out[:, q] = n
        return out[:, :-1]

    def _rounded(self, quanta: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """What is drawn if no queue's quantum is under one id, else counts could fall."""
        n = windows.astype(np.uint64) * np.uint64(self.length)
        high, low, q = n >> np.uint64(32), n & np.uint64(_ONE - 1), quanta.astype(np.uint64)
        credit = low[:, None] * q
        whole = (high[:, None] * q + (credit >> np.uint64(32))).astype(np.int64)
        deficit = (credit & np.uint64(_ONE - 1)).astype(np.int64)
        order = np.argsort(-deficit, axis=1, kind="stable")
        short = n.astype(np.int64) - whole.sum(axis=1)
        extra = np.zeros_like(whole)
        np.put_along_axis(extra, order, (np.arange(len(quanta)) < short[:, None]).astype(np.int64), axis=1)
        return whole + extra

    def places(self, queue: int, tape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset there of single ids of a queue's tape."""
        window, offset = np.zeros_like(tape), np.zeros_like(tape)
        phase = np.searchsorted(self.bases[:, queue], tape, side="right") - 1
        for k in np.unique(phase).tolist():
            mine = np.flatnonzero(phase == k)
            quanta, n = self.quanta[k], self.first[k + 1] - self.first[k]
            if quanta is None:
                window[mine] = self.first[k]
                offset[mine] = tape[mine] - self.bases[k, queue] + (self.bases[k + 1] - self.bases[k])[:queue].sum()
                continue
            rate = int(quanta[queue]) * self.length / _ONE
            for own in np.split(mine, range(4096, len(mine), 4096)):
                at = tape[own] - self.bases[k, queue]
                lo = np.clip(np.floor((at - 4) / rate).astype(np.int64) - 1, 0, n - 1)
                hi = np.clip(np.ceil((at + 4) / rate).astype(np.int64) + 2, 1, n)
                while (hi - lo > 1).any():
                    mid, back = np.unique((lo + hi) // 2, return_inverse=True)
                    early = self.drawn(quanta, mid)[back, queue] <= at
                    lo, hi = np.where(early, mid[back], lo), np.where(early, hi, mid[back])
                now, back = np.unique(lo, return_inverse=True)
                before = self.drawn(quanta, now)
                ahead = (self.drawn(quanta, now + 1) - before)[:, :queue].sum(axis=1)
                window[own] = self.first[k] + lo
                offset[own] = ahead[back] + at - before[back, queue]
        return window, offset

    def cuts(self, queue: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that draw tape [start, stop) of a queue: number, tape position, offset there."""
        out = []
        own = self.bases[:, queue]
        first, last = np.searchsorted(own, [start, stop - 1], side="right") - 1
        for k in range(int(first), int(last) + 1):
            quanta, n = self.quanta[k], self.first[k + 1] - self.first[k]
            if quanta is None:
                before = self.bases[k : k + 2]
                lo = 0
            else:
                if not quanta[queue]:
                    continue
                rate = int(quanta[queue]) * self.length
                lo = max(0, (max(start, int(own[k])) - int(own[k]) - 3) * _ONE // rate - 1)
                hi = min(n, (min(stop, int(own[k + 1])) - int(own[k]) + 3) * _ONE // rate + 2)
                before = self.drawn(quanta, np.arange(lo, hi + 1)) + self.bases[k]
            takes = np.diff(before, axis=0)
            out.append((self.first[k] + lo + np.arange(len(takes)), before[:-1, queue], takes[:, :queue].sum(axis=1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _tokenize(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    end, width = np.array([end_id], dtype=coder.dtype).tobytes(), coder.dtype.itemsize
    drawn: dict[str | None, int] = {}
    part = TaskContext.get().partitionId()
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = batch.slice(lo, 512)
            ids = [x + end for x in coder.encode_all(rows.column("text").to_pylist())]
            counts, starts = [len(x) // width for x in ids], []
            for source, n in zip(rows.column("source").to_pylist(), counts, strict=True):
                starts.append(drawn.get(source, 0))
                drawn[source] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "local_start", "n_tokens", "ids"],
            )
    give_back()


def _pieces(batches: Iterator[pa.RecordBatch], plan: Schedule, dtype: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        queue = batch.column("queue").to_numpy()
        tape = batch.column("tape_base").to_numpy() + batch.column("local_start").to_numpy()
        count = batch.column("n_tokens").to_numpy()
        ids = batch.column("ids")
        single = batch.column("way").is_valid().to_numpy(zero_copy_only=False) | np.isin(queue, list(plan.thin))

        def made(rows: np.ndarray, begins: np.ndarray, size: np.ndarray, window: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            crc, kept, last, data = [], [], -1, None
            for d, b, n in zip(rows.tolist(), begins.tolist(), size.tolist(), strict=True):
                if d != last:
                    last, data = d, np.frombuffer(ids[d].as_buffer(), dtype=dtype).astype("<u4")
                crc.append(zlib.crc32(data[b : b + n]))
                if with_ids:
                    kept.append(data[b : b + n].tobytes())
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(rows)),
                "start": pa.array(begins, pa.int64()),
                "length": pa.array(size, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(count[rows], pa.int64()),
                "sequence_id": pa.array(window, pa.int64()),
                "offset": pa.array(offset, pa.int64()),
                "source": batch.column("source").take(pa.array(rows)),
            }
            if with_ids:
                out["ids"] = pa.array(kept, pa.binary())
            return pa.RecordBatch.from_pydict(out)

        own = np.flatnonzero(~single)
        order = own[np.lexsort((tape[own], queue[own]))]
        breaks = np.flatnonzero((np.diff(queue[order]) != 0) | (tape[order][1:] != (tape + count)[order][:-1])) + 1
        for run in np.split(order, breaks):
            if not len(run):
                continue
            begin = tape[run]
            start, stop = int(begin[0]), int(begin[-1] + count[run[-1]])
            window, at, offset = plan.cuts(int(queue[run[0]]), start, stop)
            cut = np.unique(np.concatenate([begin, at[(at > start) & (at < stop)]]))
            size = np.diff(np.append(cut, stop))
            doc = np.searchsorted(begin, cut, side="right") - 1
            w = np.searchsorted(at, cut, side="right") - 1
            yield made(run[doc], cut - begin[doc], size, window[w], offset[w] + cut - at[w])
        apart = np.flatnonzero(single)
        apart = apart[np.argsort(queue[apart], kind="stable")]
        # Few rows at once, as each id has its numbers here.
        for rows in np.split(apart, np.flatnonzero((np.diff(queue[apart]) != 0) | (np.diff(np.cumsum(count[apart]) >> 18) != 0)) + 1):
            if not len(rows):
                continue
            places, first = [], np.cumsum(count[rows]) - count[rows]
            for r in rows.tolist():
                at = tape[r] + np.arange(count[r])
                way = batch.column("way")[r].as_py()
                places.append(at if way is None else _climb(at, batch.column("source_tokens")[r].as_py(), way))
            window, offset = plan.places(int(queue[rows[0]]), np.concatenate(places))
            new = (np.diff(window, prepend=-1) != 0) | (np.diff(offset, prepend=-1) != 1)
            new[first] = True
            cut = np.flatnonzero(new)
            doc = np.searchsorted(first, cut, side="right") - 1
            yield made(rows[doc], cut - first[doc], np.diff(np.append(cut, len(new))), window[cut], offset[cut])
    give_back()


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = 1024,
    end_id: int = 0,
    mixture: dict[str, float] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source[, ids].

    `mixture` gives target weights by source; without it the targets are the
    sources' shares of all ids, so every queue lasts to the last window. Sources
    that it doesn't name keep their share. Named sources have queues of their own,
    however small they are; names that no document has are ignored.
    """
    path = tokenizer or default_tokenizer()
    dtype = encoder(path).dtype.str
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = written(
        docs.select("doc_id", "source", "text").mapInArrow(lambda b: _tokenize(b, path, end_id), f"doc_id {kind}, source string, part int, local_start long, n_tokens long, ids binary"),
        "packing-ids",
    )
    sums = tokens.groupBy("part", "source").agg(F.sum("n_tokens").alias("n"))
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    if not total:
        return spark.createDataFrame([], columns)
    mixture = mixture or {}
    if any(w <= 0 for w in mixture.values()):
        raise ValueError("a source's target is not positive")
    named = F.when(F.col("source").isNull(), None in mixture).otherwise(F.col("source").isin([n for n in mixture if n is not None]))
    # Besides the named ones, at most length / 2 rows can pass this filter.
    large = sorted(by_source.filter((F.col("n") * length >= 2 * total) | named).collect(), key=lambda r: (r.source is None, r.source))
    totals = [r.n for r in large]
    weights = [mixture.get(r.source, r.n / total) for r in large]
    queues = spark.createDataFrame([(r.source, i) for i, r in enumerate(large)], "source string, queue int")
    ways = spark.createDataFrame([], "source string, source_tokens long, way array<long>")
    if rest := total - sum(totals):
        totals, weights = [*totals, rest], [*weights, rest / total]
        bucket = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(_BUCKETS))
        small = by_source.join(F.broadcast(queues), by_source.source.eqNullSafe(queues.source), "left_anti").withColumn("bucket", bucket)
        sizes = sorted((r.bucket, r.n) for r in small.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
        above = dict(zip([b for b, _ in sizes], _ways([n for _, n in sizes]), strict=True))

        def nest(table: pa.Table) -> pa.Table:
            table = table.sort_by("source")
            own = [w + above[table.column("bucket")[0].as_py()] for w in _ways(table.column("n").to_pylist())]
            return pa.table({"source": table.column("source"), "source_tokens": table.column("n"), "way": pa.array(own, pa.list_(pa.int64()))})

        ways = small.groupBy("bucket").applyInArrow(nest, ways.schema)
    plan = Schedule(totals, weights, length)
    queued = sums.join(F.broadcast(queues), sums.source.eqNullSafe(queues.source), "left").select("part", sums.source, "n", F.coalesce("queue", F.lit(len(large))).alias("queue"))
    queued = queued.join(ways, queued.source.eqNullSafe(ways.source), "left").drop(ways.source)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = queued.select(F.col("part").alias("p"), F.col("source").alias("s"), "queue", "source_tokens", "way", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tape_base"))
    # Written first, so that the planner knows its size: small, it is broadcast and the ids are not shuffled.
    bases = written(bases, "packing-bases")
    placed = tokens.join(bases, (tokens.part == bases.p) & tokens.source.eqNullSafe(bases.s))
    placed = placed.select("doc_id", "source", "queue", "source_tokens", "way", "tape_base", "local_start", "n_tokens", "ids")
    return placed.mapInArrow(lambda b: _pieces(b, plan, dtype, with_ids), columns)
