"""64-bit hashes of words and word shingles, for many texts at once in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its hash is a
polynomial over random byte values modulo 2**64, taken from prefix sums over the
whole block of texts, then mixed; a shingle's combines its words' in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SEGMENT = 1 << 21
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SEGMENT + (1 << 16), np.uint64(_BASE))]), dtype=np.uint64)
_INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_SEGMENT + (1 << 16), np.uint64(pow(_BASE, -1, 1 << 64)))]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of a block shorter than the power tables."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = _IS_WORD[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * _POWERS[: len(raw)], dtype=np.uint64)])
    return mix((sums[last] - sums[first]) * _INVERSE[first] + (last - first).astype(np.uint64)), first


def _long(data: bytes) -> np.ndarray:
    """Word hashes of a text of any length; words are never cut."""
    out, at = [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        while end < len(data) and _IS_WORD[data[end]] and end - at < len(_POWERS) - 1:
            end += 1
        if end < len(data) and _IS_WORD[data[end]]:  # one word longer than the tables: reduce it piecewise
            stop = end
            while stop < len(data) and _IS_WORD[data[stop]]:
                stop += 1
            begin = end
            while begin > at and _IS_WORD[data[begin - 1]]:
                begin -= 1
            out.append(_segment(data[at:begin])[0])
            pieces = np.concatenate([_segment(data[i : min(i + _SEGMENT, stop)])[0] for i in range(begin, stop, _SEGMENT)])
            out.append(mix((pieces * (np.arange(len(pieces), dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(keepdims=True, dtype=np.uint64)))
            end = stop
        else:
            out.append(_segment(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds): text i has words bounds[i]:bounds[i + 1]."""
    parts, counts = [], np.zeros(len(texts) + 1, dtype=np.int64)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            starts = np.cumsum([0, *(len(texts[i]) + 1 for i in held)])
            hashes, first = _segment(b"\n".join(texts[i] for i in held))
            counts[np.array(held) + 1] = np.diff(np.searchsorted(first, starts))
            parts.append(hashes)
        held, size = [], 0

    for i, t in enumerate(texts):
        if len(t) >= _SEGMENT // 2:
            flush()
            parts.append(_long(t))
            counts[i + 1] = len(parts[-1])
            continue
        if size + len(t) + 1 >= _SEGMENT:
            flush()
        held.append(i)
        size += len(t) + 1
    flush()
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_hashes(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of n-word shingles in order; a text of fewer words has one of them all."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(n, len(words))):
        total[: len(words) - k] += words[k:] * np.uint64(2 * k + 3)
        total[: len(words) - k] *= np.uint64(_BASE)
    index = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], sizes) + np.repeat(bounds[:-1], sizes)
    hashes = total[index]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        one = 0
        for k, w in enumerate(words[bounds[i] : bounds[i + 1]].tolist()):
            one = (one + w * (2 * k + 3)) * _BASE % (1 << 64)
        hashes[out_bounds[i]] = np.uint64((one + int(counts[i])) % (1 << 64))
    return mix(hashes), out_bounds


def blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted within the text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[first], np.concatenate([[0], np.cumsum(np.bincount(t[first], minlength=len(bounds) - 1))])


class Permutations:
    """MinHash functions: the high half of odd multiples of mixed hashes."""

    def __init__(self, n: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, size=n, dtype=np.uint64)

    def minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(len(starts), n) minima of the runs of `hashes` that begin at `starts`, none of them empty."""
        out = np.empty((len(starts), len(self.a)), dtype=np.uint32)
        for k in range(len(self.a)):
            values = ((hashes * self.a[k] + self.b[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(values, starts) if len(starts) else 0
        return out
