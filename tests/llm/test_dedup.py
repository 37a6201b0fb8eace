import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontam, line_dedup, ngram_join, shingles
from palimpsest.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_shingle_hashes_agree_with_sets():
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["a", "b", "é", "dd"]) for _ in range(draw.randrange(40))) + draw.choice(["", "\n", "\x0b "]) for _ in range(300)] + ["x" * 3_000_000 + " " + "y z " * 10]
    sets, bounds = shingles.distinct(*shingles.shingle_hashes([t.encode() for t in texts]))
    own = [shingle_set(t) for t in texts]
    assert [bounds[i + 1] - bounds[i] for i in range(len(texts))] == [len(s) for s in own]
    hashed = [set(sets[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
    for i in range(0, 300, 7):
        for j in range(0, 300, 11):
            assert len(hashed[i] & hashed[j]) == len(own[i] & own[j])


def brute_join(docs):
    """{position: (class by position, links)} over texts."""
    sets = [shingle_set(t) for t in docs]
    links, label = Counter(), list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(docs))], links


@pytest.mark.parametrize("block", [512, 3])
def test_join_equals_brute_force(spark, sample, block):
    texts = [r.text for r in sample["documents"].select("text").collect()]
    draw = random.Random(5)
    base = [f"v{draw.randrange(10_000)}" for _ in range(120)]
    for _ in range(25):  # a chain of variants, some linked only through others
        base = list(base)
        base[draw.randrange(120)] = f"v{draw.randrange(10_000)}"
        texts.append(" ".join(base))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute_join(texts)
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, block=block).collect()}
    assert found == {i: (classes[i], links[i]) for i in range(len(texts))}
    assert {r.doc_id for r in ngram_join.keep_one(df, block=block).collect()} == set(classes)


@pytest.mark.parametrize("block", [512, 7])
def test_join_counts_links_without_a_common_prefix(spark, block):
    draw, words = random.Random(8), [f"v{i}" for i in range(120)]
    texts = [" ".join(w if k != at else f"n{i}" for k, w in enumerate(words)) for i, at in enumerate(draw.choices(range(120), k=60))]
    classes, links = brute_join(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # Few short prefixes: the group is one component, but many of its pairs share none.
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df, trees=4, depth=4, recall=0.85, block=block).collect()}
    assert found == {i: (classes[i], links[i]) for i in range(len(texts))}


def test_join_counts_once_beside_an_empty_block(spark):
    # Two blocks a pair: in about half of the 24 pairs both texts are dealt to one of them.
    rows = [(2 * p + v, " ".join(f"p{p}w{i}" for i in range(80)) + " end" * v) for p in range(24) for v in (0, 1)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), block=1).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == {i: (i - i % 2, 1) for i, _ in rows}


def test_forest_recall_against_brute_force(spark):
    """Pairs just over the threshold, beside a group that keeps its long prefixes."""
    draw, rows = random.Random(12), []
    for p in range(150):
        words = [f"p{p}w{i}" for i in range(100)]
        rows += [words, [w if k != 30 and k != 70 else "new" for k, w in enumerate(words)]]  # 86 of 106 shingles
    base = [f"b{i}" for i in range(400)]
    rows += [[w if k != at else f"n{at}" for k, w in enumerate(base)] for at in draw.sample(range(400), 40)]
    texts = [" ".join(w) for w in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute_join(texts)
    found = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()}
    assert sum(found[i] == (classes[i], links[i]) for i in range(len(texts))) >= 0.99 * len(texts)
    assert sum(links[i] for i in range(300)) == 300 and sum(found[i][1] for i in range(300)) >= 297


def test_join_cases(odd_docs, no_docs):
    found = [(r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(odd_docs).collect()]
    assert len(found) == odd_docs.count()
    by_id = {i: (c, n) for i, c, n in found}
    assert by_id[0] == (0, 2) and by_id[1] == (0, 2) and by_id[10] == (0, 2) and by_id[2] == (2, 0) and by_id[7] == (7, 1)
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and 1 not in ids and {0, 2, 3, 4} <= set(ids) and ids.count(None) == 2
    assert ngram_join.join(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200), (5, 5)] + [(500, k) for k in range(501, 600)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(61)) and found[300] == 100 and all(found[k] == 500 for k in range(500, 600))


def test_edit_automaton(spark):
    draw, pairs = random.Random(1), []
    for _ in range(1500):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(4, 24)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            i = draw.randrange(len(b) + 1)
            b[i : i + draw.randint(0, 1)] = draw.choice(["", "a", "é"])
        b = "".join(b)
        if b and abs(len(a) - len(b)) <= 2:
            pairs.append((a, b, distance(a, b) <= 2))
    df = spark.createDataFrame(pairs, "a string, b string, near boolean")
    df = df.withColumn("n", F.monotonically_increasing_id())
    met = [line_dedup.with_keys(df.select("n", F.col(c).alias("line")), 2, 1).select("n", "key") for c in "ab"]
    met = met[0].join(met[1], ["n", "key"]).select("n").distinct().withColumn("met", F.lit(True))
    df = df.join(met, "n", "left").select(
        "near", line_dedup.within(F.split("a", ""), F.split("b", ""), 2).alias("found"), F.coalesce("met", F.lit(False)).alias("met"), (F.least(F.length("a"), F.length("b")) >= 3).alias("fit"),
    )
    assert df.filter("near != found").count() == 0
    assert df.filter("near and fit and not met").count() == 0
    assert df.filter("near").count() > 100


def brute_lines(docs, max_edits=2, per_edit=10):
    """Texts without lines that repeat, or nearly repeat, an earlier one; docs are (id, text) with distinct ids."""

    def close(x, y):
        edits = min(max_edits, min(len(x), len(y)) // per_edit)
        return abs(len(x) - len(y)) <= edits and distance(x, y) <= edits

    first, out = {}, {}
    order = [(i, no, line) for i, t in sorted(docs) for no, line in enumerate((t or "").split("\n")) if WORD.search(line)]
    for i, no, line in order:
        first.setdefault(line, (i, no))
    lines = sorted((p, x) for x, p in first.items() if len(x) >= per_edit)
    near = {x for k, (_, x) in enumerate(lines) if any(close(x, y) for _, y in lines[:k])}
    for i, t in docs:
        if t is not None:
            kept = [x for no, x in enumerate(t.split("\n")) if not WORD.search(x) or (first[x] == (i, no) and x not in near)]
            out[i] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    draw = random.Random(9)
    lines = ["".join(draw.choice("abcde ") for _ in range(draw.randint(1, 40))) for _ in range(60)]
    for _ in range(80):
        x = list(draw.choice(lines))
        x[draw.randrange(len(x))] = draw.choice("xyz")
        lines.append("".join(x))
    docs = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_lines(docs)
    for block, most in ((32, 64), (2, 64), (2, 3)):
        assert {r.doc_id: r.text for r in line_dedup.report(df, block=block, most=most).collect()} == want
    kept = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert all(want[i] == t for i, t in kept.items())
    assert set(want) - set(kept) == {i for i, t in docs if WORD.search(t) and not WORD.search(want[i])}


@pytest.mark.parametrize("shared", ["a beginning of twenty-five", "one that takes nearly all of the characters of the whole line, to the end "])
def test_line_dedup_splits_a_common_segment(spark, shared):
    """Lines that agree in most segments: split to the last level, with edits on both sides of it."""
    draw, lines = random.Random(4), []
    for _ in range(400):
        tail = "".join(draw.choice("abcdefgh") for _ in range(draw.choice([6, 12, 30])))
        x = list(shared + tail if draw.random() < 0.7 else tail + shared)
        for _ in range(draw.choice([0, 0, 1, 2])):
            i = draw.randrange(len(x))
            x[i : i + draw.randint(0, 1)] = draw.choice(["", "x", "é"])
        lines.append("".join(x))
        if draw.random() < 0.4:
            x = list(draw.choice(lines))
            for _ in range(draw.choice([1, 2, 3])):
                i = draw.randrange(len(x))
                x[i : i + draw.randint(0, 1)] = draw.choice(["", "y"])
            lines.append("".join(x))
    docs = [(i, x) for i, x in enumerate(lines)]
    found = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string"), most=8, block=4).collect()
    assert {r.doc_id: r.text for r in found} == brute_lines(docs)


def test_line_dedup_keys_do_not_multiply_in_a_group_of_copies(spark, monkeypatch):
    """Long lines with one or two other words: few keys a line, whatever the size of the group, and no partner lost."""
    draw, lines = random.Random(1), []
    vocabulary = ["".join(draw.choice("etaoinsrhl") for _ in range(draw.randint(2, 9))) for _ in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(90)]
    for _ in range(1500):
        words = list(base)
        for _ in range(draw.choice([1, 2])):
            words[draw.randrange(90)] = draw.choice(vocabulary)
        lines.append(" ".join(words))
        if draw.random() < 0.1:
            x = list(lines[-1])
            x[draw.randrange(len(x))] = draw.choice(["", "😀", "xy"])
            lines.append("".join(x))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows, write = {}, line_dedup.written

    def counting(out, name):
        out = write(out, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counting)
    found = line_dedup.report(df).collect()
    assert rows["line-groups"] < 12 * len(lines)
    assert sorted(found) == sorted(line_dedup.report(df, most=len(lines)).collect())
    assert sum(r.n_near for r in found) > 100


def test_line_dedup_deals_its_keys_once(spark, monkeypatch):
    """The counting of the keys and the join of the counts read the same shuffle files."""
    plans, write = {}, line_dedup.written

    def planned(df, name):
        if name == "line-members":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(line_dedup, "written", planned)
    docs = [(i, f"a line of some words, number {i}") for i in range(50)]
    found = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == brute_lines(docs)
    final = plans["line-members"].split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("Generate posexplode") == 1


def test_line_dedup_of_repetitive_lines(spark):
    """Fewer different grams than the edits could take."""
    draw, lines = random.Random(3), []
    for _ in range(150):
        x = list(draw.choice(["a", "ab", "abc", "a😀", "abcdefgh"]) * 40)[: draw.randint(10, 45)]
        for _ in range(draw.choice([0, 1, 2, 3])):
            i = draw.randrange(len(x))
            x[i : i + draw.randint(0, 1)] = draw.choice(["", "x", "😀"])
        lines.append("".join(x))
    docs = list(enumerate(lines))
    found = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string"), most=2, block=4).collect()
    assert {r.doc_id: r.text for r in found} == brute_lines(docs)


def test_line_dedup_of_a_hot_segment_and_a_long_line(spark):
    draw = random.Random(6)
    lines = ["a common beginning of lines " + "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(20, 60))) for _ in range(20_000)]
    long = "".join(draw.choice("abcdefgh ") for _ in range(1_000_000))
    docs = [(i, "\n".join(lines[i * 100 : i * 100 + 100])) for i in range(200)]
    docs += [(200, long), (201, long[:500_000] + "!" + long[500_001:]), (202, lines[5][:-1]), (203, long[:400_000] + "#" * 9 + long[400_000:])]
    found = {r.doc_id: (r.n_exact, r.n_near) for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {**{i: (0, 0) for i in range(201)}, 201: (0, 1), 202: (0, 1), 203: (0, 0)}


def test_line_dedup_cases(odd_docs, no_docs):
    out = line_dedup.dedup(odd_docs)
    assert out.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    ids = [i for i, _ in rows]
    assert ids.count(7) == 2 and 1 not in ids and {0, 2, 3, 4, 6, 8, 9, 10, 11} <= set(ids)
    assert dict(rows)[2] is None and dict(rows)[11].count("same line") == 1
    report = line_dedup.report(odd_docs)
    assert report.count() == odd_docs.count()
    assert line_dedup.report(no_docs).count() == 0 and line_dedup.dedup(no_docs).count() == 0


def test_decontamination_equals_brute_force(spark):
    draw = random.Random(2)
    vocabulary = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 12, 20, 37, 64, 65, 130, 300, 20, 20])]
    items[13] = (13, items[12][1])
    docs = []
    for d in range(120):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([3, 50, 900]))]
        if d % 3 == 0:
            part = draw.choice(items)[1].split()
            cut = draw.choice([0, 0, len(part) // 12, len(part) // 2])
            at = draw.randrange(len(words))
            words[at:at] = part[cut:]
        docs.append((d, " ".join(words)))
    docs += [(2000 + k, " ".join([draw.choice(vocabulary) for _ in range(700)] + [items[k][1]] + [draw.choice(vocabulary) for _ in range(700)])) for k in (2, 3)]
    docs += [(1000, items[0][1]), (1001, items[1][1]), (1002, None), (1003, ""), (None, items[7][1])]
    want = set()
    for d, t in docs:
        own = shingle_set(t)
        for i, x in items:
            s = shingle_set(x)
            if own & s and len(own & s) >= 0.8 * len(s) - 1e-12:
                want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.search(df, bench).collect()} == want
    kept = [r.doc_id for r in decontam.clean(df, bench).collect()]
    assert set(kept) == {d for d, _ in docs} - {d for d, _ in want} and len(kept) == len(set(kept))


def test_decontamination_cases(odd_docs, no_docs, sample):
    bench = sample["benchmark"]
    assert decontam.search(odd_docs, bench).count() == 0 and decontam.clean(odd_docs, bench).count() == odd_docs.count()
    assert decontam.clean(odd_docs, bench).columns == odd_docs.columns
    assert decontam.search(no_docs, bench).count() == 0 and decontam.search(odd_docs, bench.limit(0)).count() == 0
    own = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    assert {(r.doc_id, r.item_id) for r in decontam.search(odd_docs, own).collect()} >= {(0, 1), (1, 0), (6, 6), (8, 8), (5, 5)}
