"""Quality rules: a linear-chain CRF labels lines, the content share decides.

Every line with a word has a feature vector; a two-state linear-chain conditional
random field (boilerplate, content) scores the sequence and Viterbi decoding
labels it. A text is kept if the words of its content lines make up at least
`min_share` of its words and the base rules don't fail it.

The weights are fitted by maximum likelihood (forward-backward over whole sequences, Adam) on the lines
of at most `train_docs` labelled documents with at most `train_lines` lines together, chosen by a hash of the id: lines of
documents of quality 1 count as content, those of quality 0 and repeats of
earlier lines as boilerplate. Without labels of both kinds the starting weights hold.

Defined cases: null and empty texts have no words, so the base rules fail them;
very long texts are decoded whole; of equally good labellings the one that
ends in boilerplate is taken; repeated rows get equal results; an empty
table gives no rows; other columns are passed by `keep` and ignored by `assess`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import give_back, written

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_MARKS = b"!?"
FEATURES = ("bias", "letters", "capitals", "symbols", "digits", "marks", "sentence_end", "repeated_line", "repeated_words", "few_words", "words", "word_length", "bars")
#: Where fitting starts, and all there is without labels: positive speaks for content.
START = np.array([1.0, 1.0, -2.0, -4.0, -1.0, -4.0, 0.5, -1.0, -2.0, 0.0, 0.2, 0.0, -4.0])


def _without(line: bytes, chars: bytes) -> int:
    return len(line) - len(line.translate(None, chars))


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, words) of every line with a word, and how many of them repeat earlier ones."""
    rows, counts, seen, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        again = line in seen
        repeats += again
        seen.add(line)
        size = sum(map(len, words))
        letters = _without(line, _LETTERS)
        symbols = _without(line, SYMBOLS)
        rows.append(
            (
                1.0,
                letters / size,
                _without(line, _UPPER) / max(letters, 1),
                min(1.0, 5 * symbols / size),
                _without(line, _DIGITS) / size,
                min(1.0, 5 * _without(line, _MARKS) / size),
                words[-1][-1:] in b".!?",
                again,
                1 - len(set(words)) / n,
                n < 4,
                min(n, 100) / 100,
                min(size / n, 20) / 20,
                min(1.0, 3 * line.count(b"|") / n),
            )
        )
        counts.append(n)
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES)), np.array(counts, dtype=np.int64), repeats


def viterbi(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels of one sequence; emit: score of content over boilerplate, step: 2 x 2 transition scores."""
    n = len(emit)
    if not n:
        return np.zeros(0, dtype=bool)
    (a, b), (c, d) = step.tolist()
    low, high, back = 0.0, float(emit[0]), []
    for e in emit[1:].tolist():
        from_low, from_high = low + b > high + d, low + a >= high + c
        low, high = max(low + a, high + c), max(low + b, high + d) + e
        back.append((from_high, from_low))
    state = high > low
    labels = [state]
    for to_low, to_high in reversed(back):
        state = not to_high if state else not to_low
        labels.append(state)
    return np.array(labels[::-1])


def _expected(x: np.ndarray, on: np.ndarray, weights: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log normalizers, expected feature sums of content and expected transitions of sequences (time, sequence), by forward-backward."""
    t, n = on.shape
    emit = np.stack([np.zeros((t, n)), x @ weights], axis=2)
    ahead, behind = np.zeros((t, n, 2)), np.zeros((t, n, 2))
    ahead[0] = emit[0]
    for k in range(1, t):
        ahead[k] = np.where(on[k][:, None], np.logaddexp(ahead[k - 1][:, :1] + step[0], ahead[k - 1][:, 1:] + step[1]) + emit[k], ahead[k - 1])
    for k in range(t - 2, -1, -1):
        after = behind[k + 1] + emit[k + 1]
        behind[k] = np.where(on[k + 1][:, None], np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1]), 0)
    norm = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
    content = np.exp(ahead[:, :, 1] + behind[:, :, 1] - norm) * on
    pair = ahead[:-1, :, :, None] + step + (emit[1:] + behind[1:])[:, :, None, :] - norm[None, :, None, None]
    both = on[1:] & on[:-1]
    expected = np.exp(np.where(both[:, :, None, None], pair, -np.inf)).sum(axis=(0, 1))
    return float(norm.sum()), np.einsum("tnk,tn->k", x, content), expected


def likelihood(sequences: list[np.ndarray], labels: list[np.ndarray], weights: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels and its gradient in (weights, transitions); whole sequences, those of similar length together."""
    total, gradient = 0.0, np.zeros(len(weights) + 4)
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and len(sequences[order[hi]]) <= max(8, 2 * len(sequences[order[lo]])):
            hi += 1
        group = order[lo:hi]
        lo, t = hi, len(sequences[group[-1]])
        x, on = np.zeros((t, len(group), len(weights))), np.zeros((t, len(group)), dtype=bool)
        for k, i in enumerate(group):
            n, y = len(sequences[i]), labels[i].astype(int)
            x[:n, k], on[:n, k] = sequences[i], True
            gradient[: len(weights)] += y @ sequences[i]
            total += float(y @ (sequences[i] @ weights)) + float(step[y[:-1], y[1:]].sum())
            np.add.at(gradient, len(weights) + 2 * y[:-1] + y[1:], 1)
        norm, content, pairs = _expected(x, on, weights, step)
        total -= norm
        gradient -= np.concatenate([content, pairs.ravel()])
    return total, gradient


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 80, rate: float = 0.2, penalty: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood weights and transitions, by Adam."""
    weights, step = START.copy(), np.array([[0.5, -0.5], [-0.5, 0.5]])
    lines = sum(map(len, sequences))
    if not lines or len({bool(v) for y in labels for v in y}) < 2:
        return weights, step
    m = v = np.zeros(len(weights) + 4)
    for r in range(1, rounds + 1):
        _, gradient = likelihood(sequences, labels, weights, step)
        gradient = gradient / lines - penalty * np.concatenate([weights, step.ravel()])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = rate * (1 - r / rounds / 2) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        weights, step = weights + move[:-4], step + move[-4:].reshape(2, 2)
    return weights, step


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [line_features((t.as_py() or "").encode())[0] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
            names=["doc_id", "quality", "n_lines", "features"],
        )


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 2000, train_lines: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Fit on a bounded sample: at most `train_docs` labelled documents, whole, with at most `train_lines` lines together.

    Features are made where the texts are. Of rows that share an id or its labels one counts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_line_rows, f"doc_id {kind}, quality long, n_lines long, features binary")
    rows = written(rows.groupBy("doc_id").agg(F.min(F.struct("n_lines", "features", "quality")).alias("x")).select("doc_id", "x.*"), "crf-lines")
    wanted, left = [], train_lines
    for r in rows.select("doc_id", "n_lines").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most train_docs rows
        if r.n_lines <= left:
            wanted.append((r.doc_id,))
            left -= r.n_lines
    wanted = docs.sparkSession.createDataFrame(wanted, f"doc_id {kind}")
    sequences, marks = [], []
    for row in rows.join(F.broadcast(wanted), "doc_id").orderBy("doc_id").toLocalIterator():
        x = np.frombuffer(row.features).reshape(-1, len(FEATURES))
        sequences.append(x)
        marks.append((x[:, 7] == 0) & (row.quality == 1))
    return fit(sequences, marks)


def base_counts(text: str) -> tuple[bytes, int, int, int, int]:
    """(bytes, n_words, word_chars, n_symbols, n_repeat_words) of a text."""
    data = text.encode()
    words = data.split()
    three = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(three)
    repeats = 0
    if len(times) < len(three):
        covered = -1  # last word counted
        for i, w in enumerate(three):
            if times[w] > 1:
                repeats += i + 2 - max(covered, i - 1)
                covered = i + 2
    return data, len(words), len(text) - _without(data, _SPACE), _without(data, SYMBOLS), repeats


def _assess(batches: Iterator[pa.RecordBatch], weights: np.ndarray, step: np.ndarray, min_share: float, whole: bool) -> Iterator[pa.RecordBatch]:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = batch.slice(lo, 512)
            out: dict[str, list] = {c: [] for c in (*names, "base_failed", "kept", "content_share")}
            for value in rows.column("text"):
                data, n, chars, symbols, repeats = base_counts(value.as_py() or "")
                x, words, again = line_features(data)
                content = viterbi(x @ weights, step)
                share = float(words[content].sum() / n) if n else 0.0
                failed = n < 50 or 100 * repeats > 50 * n
                for c, v in zip(out, (n, chars, symbols, again, repeats, failed, not failed and share >= min_share, share), strict=True):
                    out[c].append(v)
            if whole:
                yield rows.filter(pa.array(out["kept"], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])
    give_back()


def assess(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, train_docs: int = 2000) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    weights, step = train(docs, labels, train_docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select("doc_id", "text").mapInArrow(lambda b: _assess(b, weights, step, min_share, False), columns)


def keep(docs: DataFrame, labels: DataFrame, min_share: float = 0.5, train_docs: int = 2000) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    weights, step = train(docs, labels, train_docs)
    return docs.mapInArrow(lambda b: _assess(b, weights, step, min_share, True), docs.schema)
