"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

A text is the set of its five-word shingles. Texts with equal sets collapse into
one representative, whose signature is a label of `depth` MinHash values in each of `trees` prefix
tries. A trie's nodes are prefixes: a node's texts meet by grouping on the prefix, which gives the runs of
the labels in sorted order without bringing a node that holds many texts into one task.

Prefixes are shortened text by text. All texts begin with whole labels. The texts of a
node are compared by their signatures (in cells of two blocks, so no task grows with a node);
those that agree in nearly the share of values that the threshold asks for are partners. From the
similarities of a text's partners follows the chance with which this depth finds each, and so
the recall measured on them. A text that reaches `recall` keeps its prefixes. The others, and all texts
without a partner, are shortened by one value and looked for again, at last at the length with which
even a pair just at the threshold meets in some trie with chance `recall` (24 tries
reach 0.9999 at 0.8 with five values). Nodes of that last length that hold a single
text are dropped first, by counting, so only texts that may have a partner take part.

Partners are never listed as pairs: a cell returns a spanning forest of them. Its components are
verified exactly, again in cells of two blocks of at most about `block` texts: one task holds two blocks,
computes all intersections by matrix products, counts every pair at the threshold
as a link, whether the pair itself met in a trie or not, and returns one row per text with
its number of links and one link of a spanning forest. Chance meetings don't join components, as their
signatures differ.

Defined cases: null and empty texts and texts without a word have no shingle, no
link and a class of their own; texts of one to four words have one shingle of
them all; texts of any length are read whole, and count in a cell by their shingles; null ids are kept and a class takes the least id that is not null; repeated rows
are linked like copies; pairs exactly at the threshold are links; an empty table gives no rows; other columns pass `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.shared import give_back, one_thread, written
from palimpsest.llm.shingles import Permutations, blocks, distinct, mix, shingle_hashes

_VALUE = np.dtype(">u2")  # big-endian, so that labels sort like their values


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix with which pairs at the threshold are found with chance `recall`."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


def _sign(batches: Iterator[pa.RecordBatch], trees: int, depth: int, n: int) -> Iterator[pa.RecordBatch]:
    """Adds row, set_a, set_b, n_shingles and the signature, one label after the other, to (doc, text)."""
    perms = Permutations(trees * depth)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column("text")]
        for lo, hi in blocks(texts):
            sets, bounds = distinct(*shingle_hashes(texts[lo:hi], n))
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            starts = bounds[:-1][full]
            # The minima are small numbers: their low halves are mixed before half of the bits are kept.
            values = np.zeros((hi - lo, trees * depth), dtype=_VALUE)
            values[full] = mix(perms.minima(sets, starts).astype(np.uint64)) >> np.uint64(48)
            ids = np.zeros((2, hi - lo), dtype=np.uint64)
            if len(full):
                ids[0, full] = np.add.reduceat(mix(sets), starts) + sizes[full].astype(np.uint64)
                ids[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
            empty = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.slice(lo, hi - lo) for c in batch.columns),
                    pa.array(row + np.arange(hi - lo), pa.int64()),
                    pa.array(ids[0].view(np.int64), pa.int64(), mask=empty),
                    pa.array(ids[1].view(np.int64), pa.int64(), mask=empty),
                    pa.array(sizes, pa.int64()),
                    pa.array([v.tobytes() for v in values], pa.binary()),
                ],
                names=[*batch.schema.names, "row", "set_a", "set_b", "n_shingles", "signature"],
            )
            row += hi - lo
    give_back()


def _intersections(sets: np.ndarray, bounds: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections of the texts' sets."""
    m = len(bounds) - 1
    owner = np.repeat(np.arange(m), np.diff(bounds))
    _, index, times = np.unique(sets, return_inverse=True, return_counts=True)
    shared = times[index] > 1
    number = (np.cumsum(times > 1) - 1)[index[shared]]
    owner = owner[shared]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((m, m), dtype=np.int64)
    top = int(number[-1]) + 1 if len(number) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(number, [lo, lo + width])
        part = np.zeros((m, min(width, top - lo)), dtype=np.float32)
        part[owner[a:b], number[a:b] - lo] = 1
        out += np.rint(part @ part.T).astype(np.int64)
    return out


def _roots(m: int, left: np.ndarray, right: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Least name in each text's component of the links."""
    label = names.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, left, before[right])
        np.minimum.at(label, right, before[left])
        if (label == before).all():
            return label


def _verify(table: pa.Table, threshold: float, n: int) -> pa.Table:
    one_thread()
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    rows = table.column("row").to_numpy()
    weight = table.column("copies").to_numpy()
    block = table.column("block").to_numpy()
    sets, bounds = distinct(*shingle_hashes([t.encode() for t in table.column("text").to_pylist()], n))
    size = np.diff(bounds)
    both = _intersections(sets, bounds)
    near = both >= threshold * (size[:, None] + size - both) - 1e-9
    np.fill_diagonal(near, False)
    if i != j:  # a cell of two blocks, even if one is empty: only pairs across
        near &= block[:, None] != block
    linked = near.any(axis=1)
    left, right = np.nonzero(np.triu(near))
    root = _roots(len(rows), left, right, rows)
    links = near @ weight
    return pa.table({"row": rows[linked], "links": pa.array(links[linked], pa.int64()), "root": root[linked]})


def _meet(table: pa.Table, threshold: float, trees: int, depth: int) -> pa.Table:
    """Of one cell of a node: (row, root) of a spanning forest of partners, and how many a text has, as found and as expected."""
    i, j, length = (table.column(c)[0].as_py() for c in ("i", "j", "length"))
    rows, block = table.column("row").to_numpy(), table.column("block").to_numpy()
    values = np.frombuffer(b"".join(table.column("signature").to_pylist()), _VALUE).reshape(len(rows), -1).astype(np.uint16)
    agree = np.zeros((len(rows), len(rows)), np.uint16)
    for v in values.T:
        agree += v[:, None] == v
    n = values.shape[1]
    # Six standard deviations below the threshold: a pair that is at it agrees less with a chance of about 1e-9.
    near = agree >= n * threshold - 6 * np.sqrt(n * threshold * (1 - threshold))
    np.fill_diagonal(near, False)
    if i != j:  # a cell of two blocks, even if one is empty: only pairs across
        near &= block[:, None] != block
    left, right = np.nonzero(np.triu(near))
    found = near.sum(axis=1)
    chance = 1 - (1 - (np.arange(n + 1) / n) ** length) ** trees
    expected = np.where(near, 1 / np.maximum(chance[agree], 1e-9), 0).sum(axis=1)
    some = found > 0
    root = _roots(len(rows), left, right, rows)
    return pa.table({"row": rows[some], "root": root[some], "found": pa.array(found[some], pa.int64()), "expected": pa.array(expected[some], pa.float64())})


def _in_cells(members: DataFrame, group: str, block: int, weight: str | None = None) -> DataFrame:
    """Members dealt to cells (group, i, j) of two blocks: at most about `block` rows each, or 4,000 times that in `weight`."""
    size = F.ceil(F.count("*") / F.lit(2 * block)) if weight is None else F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum(weight) / F.lit(4000 * block)))
    dealt = members.join(members.groupBy(group).agg(size.cast("int").alias("n_blocks")), group)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("row"), F.col("n_blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "n_blocks")


def _forest(reps: DataFrame, threshold: float, trees: int, depth: int, recall: float, block: int) -> DataFrame:
    """Links (a, b) that join texts with a similar signature which meet in a trie; reps: row, signature."""
    width = _VALUE.itemsize
    last = min(depth, prefix_depth(threshold, trees, depth, recall))

    def node(length: int) -> Column:
        return F.xxhash64("tree", F.substring("signature", F.col("tree") * (depth * width) + 1, F.lit(length * width)))

    labels = reps.withColumn("tree", F.explode(F.array(*map(F.lit, range(trees))))).select("row", "tree", node(last).alias("node"))
    shared = labels.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    some = written(labels.join(written(shared, "trie-nodes"), "node").select("row", "tree"), "trie-some")
    members = written(some.join(reps, "row").select("row", "tree", "signature"), "trie-members")
    links, kept = None, None
    for length in range(depth, last - 1, -1):
        now = members.withColumn("node", node(length))
        if kept is not None:
            now = now.join(kept, "row", "left")
        else:
            now = now.withColumn("keeps", F.lit(None).cast("boolean"))
        # Nodes whose texts all keep longer prefixes have been seen; nodes with the same texts do the same work.
        size = now.groupBy("node").agg(F.count("*").alias("n"), F.bool_or(F.col("keeps").isNull()).alias("open"), F.min("row").alias("low"), F.bit_xor(F.xxhash64("row")).alias("x"))
        size = size.filter("n > 1 and open").groupBy("n", "low", "x").agg(F.min("node").alias("node")).select("node")
        cells = _in_cells(now.join(size, "node").select("node", "row", "signature"), "node", block).withColumn("length", F.lit(length))
        met = cells.groupBy("node", "i", "j").applyInArrow(lambda t: _meet(t, threshold, trees, depth), "row long, root long, found long, expected double")
        met = written(met, "trie-links")
        own = met.select(F.col("row").alias("a"), F.col("root").alias("b"))
        links = own if links is None else links.unionByName(own)
        done = met.groupBy("row").agg((F.sum("found") / F.sum("expected")).alias("recall")).filter(F.col("recall") >= recall).select("row", F.lit(True).alias("keeps"))
        kept = done if kept is None else kept.unionByName(done).distinct()
    return links.filter("a != b").distinct()


def _classes(signed: DataFrame, threshold: float, n: int, trees: int, depth: int, recall: float, block: int) -> DataFrame:
    """Per distinct set: set_a, set_b, copies, links, root, first (the least (id is null, id, row) of its rows)."""
    reps = signed.filter("set_a is not null").groupBy("set_a", "set_b").agg(
        F.min("row").alias("row"), F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    )
    reps = written(reps, "representatives")
    signatures = signed.select("row", "signature").join(reps.select("row"), "row")
    parts = components(_forest(signatures, threshold, trees, depth, recall, block))
    members = signed.select("row", "n_shingles", "text").join(parts.select(F.col("node").alias("row"), F.col("root").alias("part")), "row")
    members = members.join(reps.select("row", "copies"), "row")
    cells = _in_cells(members, "part", block, "n_shingles").drop("n_shingles")
    found = written(cells.groupBy("part", "i", "j").applyInArrow(lambda t: _verify(t, threshold, n), "row long, links long, root long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    out = reps.join(links, "row", "left").join(roots.select(F.col("node").alias("row"), "root"), "row", "left")
    return out.select("set_a", "set_b", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "row").alias("root"))


def _signed(docs: DataFrame, keep: bool, trees: int, depth: int, n: int) -> DataFrame:
    given = docs.select("doc_id", "text", *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if keep else []))
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema) + ", row long, set_a long, set_b long, n_shingles long, signature binary"
    return written(given.mapInArrow(lambda b: _sign(b, trees, depth, n), columns), "signatures")


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 24, depth: int = 6, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), n_links (documents at `threshold` or more)."""
    signed = _signed(docs, False, trees, depth, n)
    sets = written(_classes(signed, threshold, n, trees, depth, recall, block), "classes")
    ids = sets.groupBy("root").agg(F.min("first").alias("least"))
    sets = sets.join(ids, "root").select("set_a", "set_b", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("least.doc_id").alias("class_id"))
    return (
        signed.select("doc_id", "set_a", "set_b")
        .join(sets, ["set_a", "set_b"], "left")
        .select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = 24, depth: int = 6, recall: float = 0.9999, block: int = 512) -> DataFrame:
    """The documents less all but the one with the least id of each class; texts without a word all stay."""
    signed = _signed(docs, True, trees, depth, n)
    sets = _classes(signed, threshold, n, trees, depth, recall, block)
    kept = sets.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.row").alias("row"))
    stay = signed.select("row", "doc").join(kept, "row", "left_semi").unionByName(signed.filter("set_a is null").select("row", "doc"))
    return stay.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
