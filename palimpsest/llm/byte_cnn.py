"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read in chunks of `chunk` positions that overlap by the
filter width less one, so filters see every window of the whole text. Each
learned filter is a table of weights by (place in the window, byte); its responses
go through ReLU and are max-pooled in each chunk. A text's features are, per
filter, the mean and the maximum over all chunks; a logistic layer makes one
probability of them. Pooling needs one sum and one maximum per text, so memory does not
grow with a text's length.

The network is trained on the driver by Adam on at most `train_docs` labelled
documents of at most `train_bytes` together, chosen by a hash of the id, half of them of each label
as far as there are, in `updates` steps over shuffled batches; a step reads all chunks of its texts, as scoring does. Labels are learned
only from rows whose crc32 of the id modulo `folds` is not 0; id, source, language
and labels are never inputs.

Defined cases: null and empty texts have no window and get the probability of
zero features, and train it like others; texts of any length are read whole; texts shorter than a filter are padded with zero bytes; null ids
hash as no text and are not held out; repeated rows get equal scores; without labels
of both kinds every score is the prior share of label 1 (0.5 if there is none); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

WIDTH = 6
CHUNK = 256


class ByteNet:
    """Filters `table` (WIDTH, 256, filters) with `bias`, and the head `out` over [mean, max] features."""

    def __init__(self, filters: int = 24, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.table = (draw.standard_normal((WIDTH, 256, filters)) * 0.1).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.out = (draw.standard_normal(2 * filters) * 0.1).astype(np.float32)
        self.offset = np.float32(0)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.out]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every window of a byte array."""
        n = len(data) - WIDTH + 1
        total = np.take(self.table[0], data[:n], axis=0)
        for j in range(1, WIDTH):
            total += np.take(self.table[j], data[j : j + n], axis=0)
        return total

    def features(self, texts: list[bytes]) -> np.ndarray:
        """[mean of chunk maxima, maximum] per filter for every whole text."""
        f = len(self.bias)
        total, top = np.zeros((len(texts), f)), np.zeros((len(texts), f), np.float32)
        count = np.zeros(len(texts))
        held: list[tuple[int, bytes]] = []

        def flush() -> None:
            data = np.frombuffer(b"".join(p for _, p in held), np.uint8)
            sizes = np.array([len(p) for _, p in held])
            owner = np.array([i for i, _ in held])
            first = np.cumsum(sizes) - sizes
            # Windows that would run over a piece's end belong to no chunk: each piece ends in WIDTH - 1 spare bytes.
            chunks = -(-(sizes - WIDTH + 1) // CHUNK)
            piece = np.repeat(np.arange(len(held)), chunks)
            at = first[piece] + (np.arange(len(piece)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
            end = np.minimum(at + CHUNK, first[piece] + sizes[piece] - WIDTH + 1)
            marks = np.stack([at, end], axis=1).ravel()
            spare = np.append(self.responses(data), np.zeros((WIDTH, f), np.float32), axis=0)
            best = np.maximum(np.maximum.reduceat(spare, marks, axis=0)[::2] + self.bias, 0)
            np.add.at(total, owner[piece], best)
            np.maximum.at(top, owner[piece], best)
            np.add.at(count, owner[piece], 1)
            held.clear()

        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            for lo in range(0, max(len(t) - WIDTH + 1, 1), 64 * CHUNK):
                held.append((i, t[lo : lo + 64 * CHUNK + WIDTH - 1].ljust(WIDTH, b"\0")))
                size += len(held[-1][1])
                if size >= 1 << 17:
                    flush()
                    size = 0
        if held:
            flush()
        return np.concatenate([total / np.maximum(count, 1)[:, None], top], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts) @ self.out.astype(np.float64) + float(self.offset)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[bytes], labels: np.ndarray, updates: int = 480, rate: float = 0.01, penalty: float = 1e-4, seed: int = 5) -> ByteNet:
    """Adam on log loss; gradients reach a filter only where it is maximal, so they are sparse sums."""
    net, draw = ByteNet(), np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.float64)
    prior = labels.mean() if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.offset = np.float32(np.log((prior + 1e-3) / (1 - prior + 1e-3)))
        return net
    net.offset = np.float32(np.log(prior / (1 - prior)))
    f = len(net.bias)
    parameters = [*net.parameters(), np.zeros(1)]
    parameters[3][0] = net.offset
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in parameters]
    steps, size = 0, min(128, len(texts))
    while steps < updates:
        order = draw.permutation(len(texts))
        for lo in range(0, len(order) - size + 1, size):
            batch = order[lo : lo + size]
            pieces, owner = [], []
            for k, i in enumerate(batch.tolist()):
                for c in range(-(-max(len(texts[i]) - WIDTH + 1, 1) // CHUNK) if texts[i] else 0):
                    pieces.append(texts[i][c * CHUNK : (c + 1) * CHUNK + WIDTH - 1].ljust(CHUNK + WIDTH - 1, b"\0"))
                    owner.append(k)
            data = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), CHUNK + WIDTH - 1)
            owner = np.array(owner, dtype=np.int64)
            at, best = np.empty((len(owner), f), np.int64), np.empty((len(owner), f), np.float32)
            for some in range(0, len(owner), 256):  # a batch may hold long texts
                own = data[some : some + 256]
                total = np.take(net.table[0], own[:, :CHUNK], axis=0)
                for j in range(1, WIDTH):
                    total += np.take(net.table[j], own[:, j : j + CHUNK], axis=0)
                at[some : some + 256] = total.argmax(axis=1)
                best[some : some + 256] = np.take_along_axis(total, at[some : some + 256, None], axis=1)[:, 0]
            best = np.maximum(best + net.bias, 0)
            # Empty texts have no chunk: their features are zero.
            count = np.bincount(owner, minlength=len(batch))
            mean, top = np.zeros((len(batch), f)), np.zeros((len(batch), f), np.float32)
            if len(owner):
                full = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[full]
                mean[full], top[full] = np.add.reduceat(best, first) / count[full, None], np.maximum.reduceat(best, first)
            count = np.maximum(count, 1)
            z = np.concatenate([mean, top], axis=1) @ net.out + parameters[3][0]
            error = (1 / (1 + np.exp(-z)) - labels[batch]) / len(batch)
            to_best = (error[:, None] * net.out[:f] / count[:, None])[owner] + (error[:, None] * net.out[f:])[owner] * (best == top[owner])
            to_best *= best > 0
            table = np.zeros((WIDTH, 256, f))
            kinds = np.broadcast_to(np.arange(f), at.shape)
            for j in range(WIDTH):
                np.add.at(table[j], (np.take_along_axis(data, at + j, axis=1), kinds), to_best)
            gradients = [table, to_best.sum(axis=0), np.concatenate([mean, top], axis=1).T @ error, np.array([error.sum()])]
            steps += 1
            for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
                g = g + penalty * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * max(0.0, 1 - steps / updates) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(p.dtype)
    net.offset = np.float32(parameters[3][0])
    return net


def held_out(folds: int = 5, remainder: int = 0) -> Column:
    """Whether crc32 of the id as text modulo `folds` is `remainder`; null ids are not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == remainder, F.lit(False))


def _score(batches: Iterator[pa.RecordBatch], net: ByteNet, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = batch.slice(lo, 512)
            scores = net.scores([(t.as_py() or "").encode() for t in rows.column("text")])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_docs: int = 3000, train_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    # At most train_docs ids; of rows that share an id one counts.
    chosen = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2) for q in (1, 0)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("text").alias("size"), "text", "quality")).alias("x")).select("doc_id", "x.*"), "cnn-texts")
    wanted, left = [], {0: train_bytes // 2, 1: train_bytes // 2}
    for r in rows.select("doc_id", "size", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["size"] <= left[r.quality]:
            wanted.append((r.doc_id,))
            left[r.quality] -= r["size"]
    texts, marks = [], []
    for row in rows.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, f"doc_id {kind}")), "doc_id").orderBy("doc_id").toLocalIterator():
        texts.append(row.text.encode())
        marks.append(row.quality)
    net = train(texts, np.array(marks))
    given = docs.select("doc_id", held_out().alias("held_out"), "text")
    return given.mapInArrow(lambda b: _score(b, net, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")
