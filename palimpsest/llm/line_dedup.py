"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line goes if it equals an earlier line, or if an earlier line is within the edits
that the shorter of the two allows: one per `per_edit` characters, at most
`max_edits`. Earlier means a smaller (id, line number); ids that are null come last.

The edit join splits a line into one segment more than its edits. For two lines
within d edits there is a segment i of the shorter one which occurs unchanged in the
other, with at most i - 1 edits to its left and d + 1 - i to its right; this bounds
its shift, so each line yields its own segments and its substrings at just those shifts, for its own
length and each shorter one that the edits can bridge. Keys with a single distinct
line are dropped by counting, and so are keys that are no line's own. The lines of keys with more
than `most` lines meet by their rarest grams instead. Lines that share a key are verified by a
banded bit-parallel automaton: one bit per diagonal and edit count, advanced over
the characters. A key is dealt over cells of two blocks of at most about `block`
lines and `cell_chars` characters; a cell returns lines to drop, never pairs.

Defined cases: null texts stay null and have no line; blank lines stay; rows with
the same id and text are one document, and none of them loses lines to another;
texts that share an id are kept apart; texts and lines of any length are read
whole (a line over `cell_chars` has cells with few others); of equal lines the one
with the smallest (id, hash of the text, line number) stays; an empty table gives no rows; other columns
are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

_TEXT_KEY = "xxhash64(text)"
#: Lines within d edits differ by at most d in the number of characters of each of these sets, and by 2d over all sets.
_COUNTED = (*"etaoinsrhlducm", "0123456789", " .,;:-")
_PIECE = 16
#: Characters of a gram; every gram, from each character on that is not the second half of a surrogate pair.
_GRAM = 3
_GRAMS = rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{_GRAM - 1}}}))"
#: Lines of a hot key, about, in which grams are counted, and the number of counters.
_SAMPLE, _BUCKETS = 8, 1 << 14


def with_segments(rows: DataFrame) -> DataFrame:
    """Adds the number and least size of the segments of a text's partners, and how many have one character more.

    `rows` have the text's `size`, `extra` (how much longer it is than its partners) and `edits` (by how many at
    most they differ). A text of n characters falls into even segments; the last ones take the remainder.
    """
    base = F.call_function("div", F.col("size") - F.col("extra"), F.col("edits") + 1).cast("int")
    rows = rows.withColumn("base", base)
    return rows.withColumn("more", F.col("size") - F.col("extra") - F.col("base") * (F.col("edits") + 1))


def segment_keys(text: str, max_edits: int, salt: Column) -> list[tuple[Column, Column, Column, Column, Column]]:
    """(key, or null where this one doesn't apply; number, shift, begin and size of its segment) of rows `with_segments`."""
    out = []
    size, extra, edits, base, more = (F.col(c) for c in ("size", "extra", "edits", "base", "more"))
    for i in range(max_edits + 1):
        longer = F.greatest(F.lit(0), F.lit(i - 1) - edits + more)
        own = base + F.when(F.lit(i - 1) - edits + more >= 0, 1).otherwise(0)
        last = i == max_edits
        for shift in [extra] if last else map(F.lit, range(-i, i + 1)):
            begin = base * i + longer + shift
            fits = (edits == i) & (F.abs(extra) <= i) if last else F.abs(shift - extra) <= edits - i
            out.append((F.when(fits, F.xxhash64(salt, F.lit(i), size - extra, F.substring(text, begin + 1, own))), F.lit(i), shift, begin, own))
    return out


def with_keys(lines: DataFrame, max_edits: int, per_edit: int) -> DataFrame:
    """Per kind of partner (edits, extra) and `kind` of segment: a line's `key`, and whether it is its `own`; the other columns are passed on.

    A key is a line's own if it is the shorter one's: the line's segment at its own place, for partners not shorter than it.
    """
    kinds = [F.struct(F.lit(e).alias("edits"), F.lit(x).alias("extra")) for e in range(max_edits, 0, -1) for x in range(e + 1)]
    rows = lines.withColumn("size", F.char_length("line")).filter(F.col("size") >= per_edit).withColumn("k", F.explode(F.array(*kinds)))
    rows = rows.withColumn("edits", F.col("k.edits")).withColumn("extra", F.col("k.extra")).drop("k")
    # The shorter of two lines says how many edits they may differ by.
    rows = rows.filter(F.least(F.lit(max_edits), F.call_function("div", F.col("size") - F.col("extra"), F.lit(per_edit))) == F.col("edits"))
    rows = with_segments(rows)
    keys = segment_keys("line", max_edits, F.lit(0))
    rows = rows.select(*lines.columns, "size", "edits", "extra", F.posexplode(F.array(*[k for k, *_ in keys])).alias("kind", "key")).filter("key is not null")
    at_home = F.element_at(F.array(*[shift == 0 for _, _, shift, *_ in keys]), F.col("kind") + 1)
    return rows.withColumn("own", (F.col("extra") == 0) & at_home)


def _automaton(a: Column, b: Column, max_edits: int) -> Column:
    """State after arrays of characters: bit d of edit count e says a[: j + d - max_edits] matches b[:j] with e edits."""
    width = 2 * max_edits + 1
    full = (1 << width) - 1

    def equal(j: Column) -> Column:
        hits = [F.when(F.get(a, j + (d - max_edits)) == F.get(b, j), 1 << d).otherwise(0) for d in range(width)]
        total = hits[0]
        for h in hits[1:]:
            total = total + h
        return total

    def advance(state: Column, same: Column) -> Column:
        rows, out, below = [F.shiftright(state, width * e).bitwiseAND(full) for e in range(max_edits + 1)], None, None
        for e, row in enumerate(rows):
            now = row.bitwiseAND(same)
            if e:
                now = now.bitwiseOR(rows[e - 1]).bitwiseOR(F.shiftright(rows[e - 1], 1)).bitwiseOR(F.shiftleft(below, 1)).bitwiseAND(full)
            below = now
            out = now if out is None else out.bitwiseOR(F.shiftleft(now, width * e))
        return out

    start = 0
    for e in range(max_edits + 1):
        start |= sum(1 << (max_edits + d) for d in range(e + 1)) << (width * e)
    masks = F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(0), F.size(b) - 1), equal)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(masks, F.lit(start), advance)


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def within(a: Column, b: Column, max_edits: int, edits: Column | int | None = None) -> Column:
    """Whether arrays of characters differ by at most `edits` edits (`max_edits` by default, and never more)."""
    diagonal = F.size(a) - F.size(b) + max_edits
    width = 2 * max_edits + 1
    row = F.lit(max_edits if edits is None else edits)
    inside = (diagonal >= 0) & (diagonal < width)
    return inside & (F.getbit(_automaton(a, b, max_edits), F.when(inside, diagonal).otherwise(0) + row * width) == 1)


def _once(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    """`test` of both, bound to variables: a lambda that held the expressions would evaluate them at every step."""
    return F.exists(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: test(p["a"], p["b"]))


def near(a: Column, b: Column, max_edits: int, edits: Column | int | None = None, window: int = 24) -> Column:
    """`within` for strings; the first characters alone end most comparisons."""
    heads = _once(_chars(F.substring(a, 1, window + max_edits)), _chars(F.substring(b, 1, window)), lambda x, y: _automaton(x, y, max_edits) != 0)
    return heads & _once(_chars(a), _chars(b), lambda x, y: within(x, y, max_edits, edits))


def _pieces(line: str) -> Column:
    """Hashes of the line's pieces of `_PIECE` characters."""
    return F.transform(F.regexp_extract_all(line, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), lambda x: F.xxhash64(x))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: pos (none, doc_id, text_key, line_no), line and its two hashes."""
    given = docs.select("doc_id", F.expr(_TEXT_KEY).alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    given = given.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    pos = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line_no").alias("pos")
    return given.select(pos, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _meeting(rows: DataFrame) -> DataFrame:
    """(key, n) of keys under which lines can be partners: at least two lines, and for one of them the key is its own.

    Lines within the edits meet under an own key of the shorter one. Copies of one text also agree in every shifted
    substring; a key of such substrings alone brings no pair that isn't found elsewhere.
    """
    line = F.shiftright("ref", 1)
    sized = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(line).alias("low"), F.max(line).alias("high"), F.max(F.col("ref").bitwiseAND(1)).alias("own"))
    return sized.filter("own = 1 and low < high").select("key", "n")


def _entries(lines: DataFrame, max_edits: int, per_edit: int) -> DataFrame:
    """(key, ref) of lines' keys, dealt by key: ref is twice the id, and one more where the key is the line's own.

    Two columns that every reader needs: with a column that only one of them reads, the planner would deal the rows
    once for each.
    """
    ref = F.shiftleft("id", 1).bitwiseOR(F.col("own").cast("long")).alias("ref")
    return with_keys(lines.select("id", "line"), max_edits, per_edit).select("key", ref).repartition("key")


def _split_hot(members: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(key, id) of keys with at most `most` lines, and instead of the others the lines' rarest grams.

    An edit takes at most `_GRAM` different grams from a line, so of two lines within d edits, with grams in one common
    order, each has one of the other's first `_GRAM` * d + 1 among its own. Lines with too few grams for that get key 0,
    and so do all that could be near one of them. The order is by frequency in a few lines of each hot key: it decides
    how long the groups are, not what is found.
    """
    sized = members.groupBy("key").agg(F.count("*").alias("n"))
    hot = written(sized.filter(F.col("n") > most), "line-hot")
    if hot.isEmpty():
        return members
    done = members.join(hot, "key", "left_anti")
    found = written(members.join(hot, "key"), "line-split")
    grams = F.transform(F.array_distinct(F.regexp_extract_all("line", F.lit(_GRAMS), F.lit(1))), lambda g: F.xxhash64(g))
    lines = texts.select("id", "edits", "line")
    lines = written(lines.join(found.select("id").distinct(), "id", "left_semi").select("id", "edits", grams.alias("grams")), "line-grams")
    some = found.filter(F.pmod(F.xxhash64("id"), "n") < _SAMPLE).select("id").distinct()
    counted = lines.join(some, "id", "left_semi").select(F.explode("grams").alias("gram")).groupBy(F.pmod("gram", F.lit(_BUCKETS)).alias("bucket")).count()
    counts = [0] * _BUCKETS
    for bucket, n in counted.collect():
        counts[bucket] = n
    order = members.sparkSession.createDataFrame([(counts,)], "counts array<int>")
    ranked = F.array_sort(F.transform("grams", lambda g: F.struct(F.get("counts", F.pmod(g, F.lit(_BUCKETS)).cast("int")).alias("n"), g.alias("gram"))))
    first = F.transform(F.slice(ranked, 1, F.col("edits") * _GRAM + 1), lambda x: x["gram"])
    few = F.when(F.size("grams") <= F.col("edits") * (2 * _GRAM), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    rare = lines.join(F.broadcast(order)).select("id", F.explode(F.concat(first, few)).alias("key"))
    rare = written(rare.select(F.xxhash64(F.lit("gram"), "key").alias("key"), "id"), "line-rare")
    shared = rare.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return done.unionByName(rare.join(shared, "key"))


def near_lines(lines: DataFrame, max_edits: int = 2, per_edit: int = 10, block: int = 32, most: int = 64, cell_chars: int = 1 << 20) -> DataFrame:
    """Of different lines (id, pos, line): the ids of those with an earlier line within the edits."""
    # Dealt once by key, as rows of two numbers, for counting and for joining the counts. The sides that grow
    # with the corpus are not offered for broadcasting.
    entries = _entries(lines, max_edits, per_edit)
    shared = _meeting(entries).select("key")
    members = written(entries.join(shared.hint("merge"), "key").select("key", F.shiftright("ref", 1).alias("id")).distinct(), "line-members")
    size = F.char_length("line")
    counts = [(size - F.char_length(F.translate("line", chars, ""))).alias(f"c{k}") for k, chars in enumerate(_COUNTED)]
    texts = lines.join(members.select("id").distinct().hint("merge"), "id", "left_semi")
    texts = texts.select("id", "pos", "line", size.alias("size"), F.least(F.lit(max_edits), F.floor(size / per_edit).cast("int")).alias("edits"), _pieces("line").alias("pieces"), *counts)
    texts = written(texts, "line-texts")
    members = written(_split_hot(members, texts, most), "line-groups")
    # Keys with the same lines do the same work: one of them is enough.
    member = F.xxhash64("id")
    same = members.join(texts.select("id", "size"), "id").groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("chars"), F.min("id").alias("low"), F.bit_xor(member).alias("x"), F.sum(member.cast("decimal(20,0)")).alias("s")
    )
    n_blocks = F.greatest(F.when(F.max("n") <= most, 1).otherwise(F.ceil(F.max("n") / block)), F.ceil(F.max("chars") / cell_chars)).cast("int")
    chosen = same.filter("n > 1").groupBy("n", "low", "x", "s").agg(F.min("key").alias("key"), n_blocks.alias("n_blocks")).select("key", "n_blocks")
    dealt = members.join(chosen, "key").join(texts, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    line = F.struct("id", "pos", "block", "line", "size", "edits", "pieces", *[f"c{k}" for k in range(len(_COUNTED))]).alias("x")
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), line).groupBy("key", "i", "j").agg(F.collect_list("x").alias("xs"))

    def has_earlier(y: Column) -> Column:
        def matches(x: Column) -> Column:
            edits = F.least(x["edits"], y["edits"])
            fits = F.abs(x["size"] - y["size"]) <= edits
            fits &= (F.col("i") == F.col("j")) | (x["block"] != y["block"])
            apart = [F.abs(x[f"c{k}"] - y[f"c{k}"]) for k in range(len(_COUNTED))]
            for d in apart:
                fits &= d <= edits
            # Both lines after their common pieces.
            differs = F.array_position(F.zip_with(x["pieces"], y["pieces"], lambda a, b: ~a.eqNullSafe(b)), True)
            at = F.when(differs > 0, (differs - 1) * _PIECE + 1).otherwise(F.least(x["size"], y["size"]) + 1).cast("int")
            fits &= (reduce(add, apart) <= 2 * edits) & (x["pos"] < y["pos"])
            return fits & F.exists(F.array(at), lambda n: near(x["line"].substr(n, x["size"]), y["line"].substr(n, y["size"]), max_edits, edits))

        return F.exists("xs", matches)

    return cells.select(F.explode(F.filter("xs", has_earlier)).alias("y")).select("y.id").distinct()


def decide(docs: DataFrame, max_edits: int = 2, per_edit: int = 10, **tuning: int) -> DataFrame:
    """Lines to drop, grouped: doc_id, text_key, exact and near (line numbers)."""
    if not 0 < max_edits <= 3:
        raise ValueError("max_edits must be 1 to 3: the automaton's state is one 32-bit integer")
    lines = _lines(docs)
    different = lines.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.first("line").alias("line"))
    different = written(different.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "pos", "n", "line"), "lines")
    close = written(near_lines(different.select("id", "pos", "line"), max_edits, per_edit, **tuning).withColumn("close", F.lit(True)), "line-near")
    rules = different.select("id", "h1", "h2", F.col("pos").alias("first"), "n").join(close, "id", "left").filter("n > 1 or close").drop("id", "n")
    again = F.col("pos") > F.col("first")
    dropped = lines.select("pos", "h1", "h2").join(rules, ["h1", "h2"]).filter(F.coalesce("close", F.lit(False)) | again)
    dropped = dropped.select("pos.doc_id", "pos.text_key", "pos.line_no", again.alias("again"))
    dropped = dropped.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.when(F.col("again"), F.col("line_no")))).alias("exact"), F.array_sort(F.collect_set(F.when(~F.col("again"), F.col("line_no")))).alias("near")
    )
    return dropped


def _joined(docs: DataFrame, drops: DataFrame) -> DataFrame:
    drops = drops.select(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key"), "exact", "near")
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "doc_id", "text", F.expr(_TEXT_KEY).alias("text_key"))
    same = given.doc_id.eqNullSafe(drops.drop_id) & (given.text_key == drops.drop_key)
    none = F.array().cast("array<int>")
    out = given.join(drops.hint("merge"), same, "left").withColumn("exact", F.coalesce("exact", none)).withColumn("near", F.coalesce("near", none))
    out = out.withColumn("lines", F.split("text", "\n"))
    # Compared as sets of numbers, so a text with very many dropped lines is rebuilt in one pass.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.array_union("exact", "near"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return out.withColumn("kept", F.when(F.size("exact") + F.size("near") == 0, F.col("text")).otherwise(kept))


def dedup(docs: DataFrame, max_edits: int = 2, per_edit: int = 10, **tuning: int) -> DataFrame:
    """The documents with all their columns, `text` without dropped lines; n_chars follows the text where it exists.

    A document that loses its last line with a word is a copy of earlier ones and goes.
    """
    out = _joined(docs, decide(docs, max_edits, per_edit, **tuning))
    lost = (F.size("exact") + F.size("near") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    out = out.filter(~F.coalesce(lost, F.lit(False)))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("kept").alias("text")
        if c == "n_chars" and docs.schema[c].dataType.simpleString() == "bigint":
            return F.coalesce(F.char_length("kept").cast("long"), F.col("doc").getField(c)).alias(c)
        return F.col("doc").getField(c).alias(c)

    return out.select(*map(column, docs.columns))


def report(docs: DataFrame, max_edits: int = 2, per_edit: int = 10, **tuning: int) -> DataFrame:
    """Per document: doc_id, n_lines, n_exact, n_near (lines dropped), text (what stays)."""
    out = _joined(docs, decide(docs, max_edits, per_edit, **tuning))
    return out.select(
        "doc_id",
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.size("exact").cast("long").alias("n_exact"),
        F.size("near").cast("long").alias("n_near"),
        F.col("kept").alias("text"),
    )
