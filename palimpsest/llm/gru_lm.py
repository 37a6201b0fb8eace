"""Gated recurrent language model with a class-factored softmax, in numpy.

Tokens are the lower-cased (A-Z) words of a text and one end. Counts of all training
tokens are exact. The `head` most frequent words are classes of 32 with a softmax
inside each; all other words fall into classes by their last two bytes: one for each of the
most frequent endings, and a few for the others by a hash. Inside such a class
a word's chance is its count plus one over the class's counts plus its distinct words plus one
(words never seen count as one more). The chance of a token is that of its class
times that inside the class, both given the state of a GRU; the state starts at
zero with a text and is carried through windows of `window` tokens over the whole of it.

Training: the driver warms the model up on at most `warm_docs` different training texts
of at most `warm_tokens` tokens together; then every task continues from there over all its
training texts by truncated backpropagation, and the results are averaged, weighted by
tokens, in a tree of tasks. Texts are dealt in blocks with their own word lists, so the counts
that a task looks up are those of its block's words: they come by one shuffle join on the word,
and no table of all words is ever held in one place. With them each text is coded once;
training and scoring read the codes where they lie.

Defined cases: null and empty texts have the end token only; null ids are not held
out; repeated rows are learned and scored as often as they come; words of any
length are whole tokens; a text of any length is stepped through window by window, and
memory grows with its codes alone; words of equal counts at the edge of the
frequent ones are taken in byte order; with no training text the model is its starting point;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import one_thread, written

GROUP = 32
#: Classes of the words outside the head: the last `HASHED` are for endings that are not frequent.
TAILS = 40
HASHED = 8
END = b""  # no word is empty
#: Tokens, about, whose class logits are worked on at once: they stay in a core's cache.
CHUNK = 1024


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether the exponentials of all logits, and at least one row's share of them, stay far from the limits of 32 bits."""
    reach = np.abs(weights).sum(axis=0)
    return bool((bias + reach).max() < 60 and (bias - reach).max() > -60)


class Gru:
    """Codes: 0 .. head - 1 are the frequent words, the next TAILS the other words' classes."""

    def __init__(self, head_counts: list[int], tail_counts: list[int], hidden: int = 16, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.groups = max(1, -(-len(head_counts) // GROUP))
        self.head = self.groups * GROUP
        counts = np.zeros(self.head)
        counts[: len(head_counts)] = head_counts
        inside = np.log(np.where(counts > 0, counts, 1e-6)).reshape(self.groups, GROUP)
        sums = np.concatenate([counts.reshape(self.groups, GROUP).sum(axis=1), np.array(tail_counts, dtype=np.float64) + 1])
        f, h = np.float32, hidden
        self.p = {
            "x": (draw.standard_normal((self.head + TAILS, 3 * h)) * 0.1).astype(f),
            "u": (draw.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(f),
            "c": np.zeros((h, self.groups + TAILS), f),
            "cb": np.log(np.maximum(sums, 1e-6) / max(sums.sum(), 1)).astype(f),
            "o": np.zeros((self.groups, GROUP, h), f),
            "ob": inside.astype(f),
        }
        self.hidden = hidden

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def run(self, codes: np.ndarray, starts: np.ndarray, targets: np.ndarray, state: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, dict | None]:
        """One window (steps, slots): natural log-chance of each target's class and place in it, the last state, gradients.

        Arrays lie by step, unit and slot: a step is one block, and all passes run over long rows. A row of ones below the
        states carries the biases.
        """
        p, h = self.p, self.hidden
        (t, b), real = codes.shape, p["x"].dtype
        # The gates' rows are negated for their exponentials.
        sign = np.repeat(np.array([-1, 1], real), [2 * h, h])
        inputs, recurrent = np.ascontiguousarray((p["x"] * sign).T), np.ascontiguousarray((p["u"] * sign).T)
        begins, keep = starts.any(axis=1).tolist(), (~starts).astype(real)
        gates, states, befores, recs = (np.empty((t, rows, b), real) for rows in (3 * h, h + 1, h, h))
        z, r, new = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        states[:, h] = 1
        now = state.T
        for k in range(t):
            before, gate, rec = befores[k], gates[k], recs[k]
            zr, fresh = gate[: 2 * h], gate[2 * h :]
            np.take(inputs, codes[k], axis=1, out=gate, mode="clip")
            np.multiply(now, keep[k] if begins[k] else real.type(1), out=before)
            sums = recurrent @ before
            zr += sums[: 2 * h]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            rec[:] = sums[2 * h :]
            fresh += zr[h:] * rec
            np.tanh(fresh, out=fresh)
            now = states[k, :h]
            np.subtract(before, fresh, out=now)
            now *= zr[:h]
            now += fresh
        is_head = targets < self.head
        kind = np.where(is_head, targets // GROUP, targets - self.head + self.groups)
        by_class = np.ascontiguousarray(np.vstack([p["c"], p["cb"]]).T)
        # States are within -1 and 1, so logits have known bounds: mostly no exponential can overflow.
        tame = _tame(p["c"], p["cb"])
        scores, to_state, g_classes = np.empty((t, b), real), np.empty((t, h, b), real), np.zeros_like(by_class)
        steps = max(1, CHUNK // b)
        for lo in range(0, t, steps):
            s, own = states[lo : lo + steps], kind[lo : lo + steps]
            e = by_class @ s
            at = own * b
            at += np.arange(len(own))[:, None] * (len(by_class) * b) + np.arange(b)
            if not tame:
                e -= e.max(axis=1, keepdims=True)
            each = e.reshape(-1)
            chosen = each.take(at)
            np.exp(e, out=e)
            sums = e.sum(axis=1)
            np.subtract(chosen, np.log(sums), out=scores[lo : lo + steps])
            if learn:
                each[at] -= sums
                g_classes += (e @ (s / sums[:, None]).transpose(0, 2, 1)).sum(axis=0)
                np.matmul(p["c"], e, out=to_state[lo : lo + steps])
                to_state[lo : lo + steps] /= sums[:, None]
        # Sorted by class, each class's tokens are one run of rows.
        kind = kind.ravel()
        order = np.argsort(kind.astype(np.uint16) if len(by_class) <= 1 << 16 else kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.groups + 1)).tolist()
        heads = order[: edges[-1]]
        step, slot = np.divmod(heads, b)
        rows = states[step, :, slot]
        words = np.concatenate([p["o"], p["ob"][:, :, None]], axis=2)
        runs = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        inside = np.empty((len(heads), GROUP), real)
        for c, own in runs:
            np.matmul(rows[own], words[c].T, out=inside[own])
        if not _tame(p["o"].transpose(2, 0, 1), p["ob"]):
            inside -= inside.max(axis=1, keepdims=True)
        each, at = inside.reshape(-1), targets.ravel()[heads] % GROUP + np.arange(len(heads)) * GROUP
        chosen = each[at]
        np.exp(inside, out=inside)
        sums = inside @ np.ones(GROUP, real)
        scores.reshape(-1)[heads] += chosen - np.log(sums)
        if not learn:
            return scores, now.T, None
        each[at] -= sums
        shares, back, g_words = rows / sums[:, None], np.empty((len(heads), h), real), np.zeros_like(words)
        for c, own in runs:
            np.matmul(inside[own].T, shares[own], out=g_words[c])
            np.matmul(inside[own], p["o"][c], out=back[own])
        back /= sums[:, None]
        to_state[step, :, slot] += back
        ahead = np.zeros((h, b), real)
        du, dx = np.empty((t, 3 * h, b), real), np.empty((3 * h, t, b), real)
        for k in range(t - 1, -1, -1):
            dh, d, zk, rk, fresh = to_state[k], du[k], z[k], r[k], new[k]
            dh += ahead
            carried = dh * zk
            dn = (dh - carried) * (1 - fresh * fresh)
            np.multiply(dn, rk, out=d[2 * h :])
            np.multiply(befores[k] - fresh, carried, out=d[:h])
            np.multiply(d[2 * h :], recs[k], out=d[h : 2 * h])
            d[: 2 * h] *= 1 - gates[k, : 2 * h]
            dx[: 2 * h, k], dx[2 * h :, k] = d[: 2 * h], dn
            ahead = p["u"] @ d
            ahead += carried
            if begins[k]:
                ahead *= keep[k]
        code, g_x = codes.ravel(), np.empty_like(p["x"])
        for j, d in enumerate(dx):
            g_x[:, j] = np.bincount(code, d.reshape(-1), minlength=len(g_x))
        u = (befores @ du.transpose(0, 2, 1)).sum(axis=0)
        g = {"x": g_x, "u": u, "c": g_classes[:, :h].T, "cb": g_classes[:, h], "o": g_words[:, :, :h], "ob": g_words[:, :, h]}
        return scores, now.T, g


class Slots:
    """Texts dealt to parallel slots of near equal length; the longer slots come first.

    The slots' tokens lie one after the other, so a long text beside short ones costs no padding.
    """

    def __init__(self, texts: list[np.ndarray], most: int = 256):
        sizes = [len(t) for t in texts]
        n = max(1, min(most, len(texts)))
        load = [(0, i) for i in range(n)]
        own: list[list[int]] = [[] for _ in range(n)]
        for i in sorted(range(len(texts)), key=lambda i: -sizes[i]):
            size, s = heapq.heappop(load)
            own[s].append(i)
            heapq.heappush(load, (size + sizes[i], s))
        own.sort(key=lambda o: -sum(sizes[i] for i in o))
        draw = np.random.default_rng(n)
        for o in own:  # else a slot's last texts would all be short ones
            draw.shuffle(o)
        self.lengths = np.array([sum(sizes[i] for i in o) for o in own])
        self.first = np.cumsum(self.lengths) - self.lengths
        order = [i for o in own for i in o]
        dealt = np.array([sizes[i] for i in order], dtype=np.int64)
        self.tokens = np.concatenate([np.zeros(0, np.uint16), *(texts[i] for i in order)])
        self.text = np.repeat(np.array(order, dtype=np.int32), dealt)
        self.starts = np.zeros(len(self.tokens), bool)
        self.starts[(np.cumsum(dealt) - dealt)[dealt > 0]] = True

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, int]]:
        """(places of the window's tokens by step and slot, its first step): as many slots as fill all steps."""
        at = 0
        while at < self.lengths[0]:
            alive = int((self.lengths > at).sum())
            stop = min(at + size, int(self.lengths[alive - 1]))
            yield self.first[:alive] + np.arange(at, stop)[:, None], at
            at = stop


def run_texts(model: Gru, texts: list[np.ndarray], end: int, window: int, learn: Adam | None = None) -> np.ndarray:
    """Natural log-chance of the classes and places of each text's codes; learns on the way if asked."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    # Scores don't depend on how many texts run side by side, weights do.
    slots = Slots(texts) if learn else Slots(texts, 1024)
    state = np.zeros((len(slots.lengths), model.hidden), np.float32)
    for places, at in slots.windows(window):
        codes = np.empty(places.shape, np.int64)
        targets = slots.tokens[places].astype(np.int64)
        codes[1:] = targets[:-1]
        codes[0] = slots.tokens[places[0] - 1] if at else end
        starts = slots.starts[places]
        codes[starts] = end
        scores, state, g = model.run(codes, starts, targets, state[: places.shape[1]], learn is not None)
        out += np.bincount(slots.text[places].ravel(), scores.ravel(), minlength=len(texts))
        if g is not None:
            learn.step(model.p, g, scores.size, scores.size / (window * len(slots.lengths)))
    return out


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict, tokens: int, share: float = 1.0) -> None:
        """One update from the gradients of `tokens`; windows that fill only a `share` of their places move the weights by less."""
        self.n += 1
        for k, d in g.items():
            d = d / tokens
            np.clip(d, -1, 1, out=d)
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * d
            d *= d
            d *= 0.01
            v *= 0.99
            v += d
            np.divide(v, 1 - 0.99**self.n, out=d)
            np.sqrt(d, out=d)
            d += 1e-8
            np.divide(m, d, out=d)
            d *= self.rate * share / (1 - 0.9**self.n)
            p[k] -= d


class _Numbers(dict):
    """Numbers words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of texts as indexes into their block's word list, then one row with the list and its training counts."""
    block = TaskContext.get().partitionId() << 32
    words = _Numbers()
    trained: list[np.ndarray] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal words, trained, size, block
        counts = np.bincount(np.concatenate(trained) if trained else np.zeros(0, np.int64), minlength=len(words))
        row = pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int64()),
                "doc_id": pa.nulls(1, kind),
                "held_out": pa.nulls(1, pa.bool_()),
                "ids": pa.nulls(1, pa.binary()),
                "words": pa.array([list(words)], pa.list_(pa.binary())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
            }
        )
        words, trained, size, block = _Numbers(), [], 0, block + 1
        return row

    kind = pa.null()
    for batch in batches:
        kind = batch.column("doc_id").type
        for lo in range(0, batch.num_rows, 256):
            rows = batch.slice(lo, 256)
            held = rows.column("held_out").to_pylist()
            ids = []
            for text, out in zip(rows.column("text"), held, strict=True):
                data = (text.as_py() or "").encode().lower()
                own = np.fromiter(map(words.__getitem__, chain(data.split(), (END,))), dtype="<u4")
                size += len(data)
                ids.append(own.tobytes())
                if not out:
                    trained.append(own)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), rows.column("doc_id"), rows.column("held_out"), pa.array(ids, pa.binary()), pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int64()))],
                names=["block", "doc_id", "held_out", "ids", "words", "counts"],
            )
            if size >= block_bytes:
                yield close()
    if words:
        yield close()


def _code(docs: pa.Table, words: pa.Table, head: int, total: int, distinct: int, tails: np.ndarray, dtype: str) -> pa.Table:
    """One block's texts as codes, with all of their scores that the network has no part in."""
    place = words.column("place").to_numpy()
    counts, codes = np.zeros(len(place), np.int64), np.zeros(len(place), np.int32)
    counts[place], codes[place] = words.column("count").to_numpy(), words.column("code").to_numpy()
    base = np.log10((counts + 1) / (total + distinct + 1))
    inside = np.where(codes >= head, np.log10((counts + 1) / tails[np.maximum(codes - head, 0)]), 0)
    coded, known = codes.astype(dtype), counts > 0
    texts = [np.frombuffer(x.as_buffer(), "<u4") for x in docs.column("ids")]
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array([len(t) for t in texts], pa.int64()),
            "n_known": pa.array([int(known[t].sum()) for t in texts], pa.int64()),
            "base_score": pa.array([float(base[t].sum()) for t in texts], pa.float64()),
            "inside": pa.array([float(inside[t].sum()) for t in texts], pa.float64()),
            "codes": pa.array([coded[t].tobytes() for t in texts], pa.binary()),
        }
    )


def _gathered(batches: Iterator[pa.RecordBatch], dtype: str, tokens: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """Rows and their codes, about `tokens` at a time."""
    held, texts, size = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = batch.slice(lo, 256)
            held.append(rows)
            texts += [np.frombuffer(x.as_buffer(), dtype) for x in rows.column("codes")]
            size += sum(map(len, texts[-rows.num_rows :]))
            if size >= tokens:
                yield pa.Table.from_batches(held), texts
                held, texts, size = [], [], 0
    if held:
        yield pa.Table.from_batches(held), texts


def _learn(batches: Iterator[pa.RecordBatch], model: Gru, end: int, window: int, rate: float, dtype: str, at_once: int) -> Iterator[pa.RecordBatch]:
    one_thread()
    learner, tokens = Adam(model.p, rate), 0
    for _, texts in _gathered(batches, dtype, at_once):
        run_texts(model, texts, end, window, learner)
        tokens += sum(map(len, texts))
    if tokens:
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "weights": pa.array([(model.flat().astype(np.float64) * tokens).tobytes()], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = 0, None
    for batch in batches:
        for n, w in zip(batch.column("tokens").to_pylist(), batch.column("weights"), strict=True):
            own = np.frombuffer(w.as_buffer(), np.float64)
            tokens, total = tokens + n, own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def _score(batches: Iterator[pa.RecordBatch], model: Gru, end: int, window: int, total: int, dtype: str, at_once: int) -> Iterator[pa.RecordBatch]:
    one_thread()
    for rows, texts in _gathered(batches, dtype, at_once):
        scores = run_texts(model, texts, end, window) / np.log(10) + rows.column("inside").to_numpy()
        columns = {c: rows.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known")}
        columns |= {"train_tokens": pa.array([total] * len(texts), pa.int64()), "base_score": rows.column("base_score").combine_chunks(), "score": pa.array(scores, pa.float64())}
        yield pa.RecordBatch.from_pydict(columns)


def _warm_texts(coded: DataFrame, dtype: str, docs: int, tokens: int) -> list[np.ndarray]:
    """Different training texts, spread by a hash over the corpus; only hashes are sorted."""
    training = coded.filter("not held_out").withColumn("hash", F.xxhash64("codes"))
    chosen, left = [], tokens
    for r in training.select("hash", "n_tokens").distinct().orderBy("hash", "n_tokens").limit(docs).collect():
        if r.n_tokens <= left:
            chosen.append((r.hash,))
            left -= r.n_tokens
    wanted = F.broadcast(coded.sparkSession.createDataFrame(chosen, "hash long"))  # at most `docs` rows
    rows = training.select("hash", "codes").join(wanted, "hash").groupBy("hash").agg(F.first("codes").alias("codes")).collect()
    return [np.frombuffer(r.codes, dtype) for r in sorted(rows, key=lambda r: r.hash)]


def score(
    docs: DataFrame,
    folds: int = 7,
    remainder: int = 2,
    head: int = 1024,
    hidden: int = 8,
    window: int = 32,
    block_bytes: int = 12 << 20,
    at_once: int = 1 << 20,
    warm_docs: int = 1000,
    warm_tokens: int = 1_000_000,
    warm_epochs: int = 3,
    rate: float = 0.01,
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == remainder, F.lit(False))
    given = docs.select("doc_id", held.alias("held_out"), "text")
    table = written(
        given.mapInArrow(lambda b: _blocks(b, block_bytes), f"block long, doc_id {kind}, held_out boolean, ids binary, words array<binary>, counts array<long>"), "lm-blocks"
    )
    texts = table.filter("ids is not null").select("block", "doc_id", "held_out", "ids")
    local = table.filter("words is not null").select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "place", "w.words", "w.counts")
    counts = written(local.groupBy("words").agg(F.sum("counts").alias("count")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    frequent = counts.filter("count > 0").orderBy(F.desc("count"), "words").limit(head).collect()
    listed = [bytes(r["words"]) for r in frequent]
    if END not in listed:
        listed = [*listed[: head - 1], END]
    by_word = {bytes(r["words"]): r["count"] for r in frequent}
    end = listed.index(END)
    # At most `head` frequent words, and fewer endings than classes.
    codes = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(listed)], "word binary, number int"))
    groups = max(1, -(-len(listed) // GROUP)) * GROUP
    ending = F.when(F.octet_length("words") <= 2, F.col("words")).otherwise(F.expr("substring(words, -2, 2)"))
    rare = counts.join(codes, counts["words"] == codes["word"], "left_anti").select(ending.alias("ending"), "count")
    common = rare.groupBy("ending").agg(F.sum("count").alias("n")).filter("n > 0").orderBy(F.desc("n"), "ending").limit(TAILS - HASHED).collect()
    endings = F.broadcast(spark.createDataFrame([(bytes(r["ending"]), i) for i, r in enumerate(common)], "ending binary, place int"))
    coded = counts.withColumn("ending", ending).join(codes, counts["words"] == codes["word"], "left").join(endings, "ending", "left")
    tail = F.coalesce("place", (F.crc32("ending") % HASHED + (TAILS - HASHED)).cast("int")) + groups
    coded = coded.select("words", "count", F.coalesce("number", tail).alias("code"))
    sums = {r["code"] - groups: (r["n"], r["v"]) for r in coded.filter(F.col("code") >= groups).groupBy("code").agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).collect()}
    tails = np.array([sum(sums.get(t, (0, 0))) + 1 for t in range(TAILS)], dtype=np.float64)
    dtype = "<u2" if groups + TAILS <= 1 << 16 else "<u4"
    known = local.select("block", "place", "words").join(coded, "words").select(F.col("block").alias("of"), "place", "count", "code")
    rows = texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        lambda d, w: _code(d, w, groups, total, distinct, tails, dtype),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, inside double, codes binary",
    )
    rows = written(rows, "lm-codes")
    model = Gru([by_word.get(w, 0) for w in listed], [sums.get(t, (0, 0))[0] for t in range(TAILS)], hidden)
    if samples := _warm_texts(rows, dtype, warm_docs, warm_tokens):
        learner = Adam(model.p, rate)
        for _ in range(warm_epochs):
            run_texts(model, samples, end, window, learner)
    learned = rows.filter("not held_out").select("codes").mapInArrow(lambda b: _learn(b, model, end, window, rate / 4, dtype, at_once), "tokens long, weights binary")
    level = written(learned, "lm-weights", "snappy")
    parts = level.rdd.getNumPartitions()
    summed = level.mapInArrow(_add, "tokens long, weights binary").repartition(max(1, int(parts**0.5))).mapInArrow(_add, "tokens long, weights binary")
    tokens, weights = 0, 0.0
    for r in summed.toLocalIterator():
        tokens, weights = tokens + r["tokens"], weights + np.frombuffer(r["weights"], np.float64)
    final = Gru([1], [0] * TAILS, hidden)
    final.p, final.groups, final.head = dict(model.p), model.groups, model.head
    if tokens:
        final.load(weights / tokens)
    return rows.mapInArrow(
        lambda b: _score(b, final, end, window, total, dtype, at_once),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
