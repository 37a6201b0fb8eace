import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing, token_store
from palimpsest.llm.tokens import Encoder, default_tokenizer, encoder, ids_of

FULL = []
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "\x85", "the", "'s", "don't", "123", "é", "Straße", "!!", "<|endoftext|>", "日本", "\0", "a,b", "x" * 40])


def exact(text):
    return encoder(default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_word_memo_gives_the_library_ids(text):
    coder = encoder(default_tokenizer())
    assert ids_of(coder.encode(text), coder.dtype).tolist() == exact(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["the", "then,", "the.\n", "a\n\nb", "x\n\n\ny", "it's", "end\n\n", "...", "é\")", "12%", "y" * 70]), max_size=30).map(" ".join))
def test_a_full_memo_gives_the_library_ids(text):
    coder = Encoder(default_tokenizer(), 4) if not FULL else FULL[0]
    FULL[:] = [coder]
    assert ids_of(coder.encode(text), coder.dtype).tolist() == exact(text)
    assert len(coder.spaced) <= 2 and len(coder.spaced.old) <= 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=1200).map(sorted))
def test_elias_fano(values):
    found = token_store.EliasFano.encode(np.array(values))
    assert found.select_range(0, len(values)).tolist() == values
    middle = len(values) // 3
    assert found.select_range(middle, len(values)).tolist() == values[middle:]
    assert [found.select(i) for i in range(0, len(values), 37)] == values[::37]
    bits = 8 * (len(found.low) + len(found.high))
    assert bits <= len(values) * (2 + max(0, np.log2(max(1, values[-1] / len(values))) + 1)) + 32


def expected(docs, end):
    out = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*exact(r.text or ""), end], dtype="<u4")
        out.append((r.doc_id, len(ids), ids))
    return out


@pytest.mark.parametrize("which", ["odd_docs", "sample", "no_docs"])
def test_store_round_trip(spark, request, which):
    docs = request.getfixturevalue(which)
    docs = docs["documents"] if which == "sample" else docs
    found = token_store.token_ids(docs).collect()
    want = expected(docs, 2)
    key = lambda t: tuple((x is not None, x) if x is not None else (False, 0) for x in t)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=key) == sorted(((i, n, zlib.crc32(x.tobytes())) for i, n, x in want), key=key)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids[: len(ids) - len(known)] == [None] * (len(ids) - len(known))


def test_random_access(sample):
    manifest = token_store.write_store(sample["documents"]).collect()
    shard = token_store.Shard(manifest[0].path)
    texts = {r.doc_id: r.text for r in sample["documents"].select("doc_id", "text").collect()}
    for i in (0, shard.n // 2, shard.n - 1):
        assert shard.document(i).tolist() == [*exact(texts[int(shard.doc_ids[i])]), 2]


@pytest.mark.parametrize("which", ["odd_docs", "sample", "no_docs"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    docs = docs["documents"] if which == "sample" else docs
    pieces = [r.asDict() for r in packing.pack(docs, with_ids=True).collect()]
    want = expected(docs, 0)
    assert sum(p["length"] for p in pieces) == sum(n for _, n, _ in want)
    sequences = {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        sequences.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    if which == "sample":
        by_doc = {i: ids for i, _, ids in want}
        whole = {}
        for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
            assert p["start"] == len(whole.setdefault(p["doc_id"], b"")) // 4 and p["doc_tokens"] == len(by_doc[p["doc_id"]])
            whole[p["doc_id"]] += p["ids"]
        assert whole == {i: ids.tobytes() for i, ids in by_doc.items()}
        total, share = sum(map(len, by_doc.values())), {}
        for p in pieces:
            share[p["source"]] = share.get(p["source"], 0) + p["length"]
        for own in sequences.values():
            if sum(p["length"] for p in own) == 1024:
                for s, n in share.items():
                    assert abs(sum(p["length"] for p in own if p["source"] == s) - 1024 * n / total) < 3


def test_schedule_with_given_weights():
    plan = packing.Schedule([5000, 20_000, 300], [0.5, 0.3, 0.2], 1024)
    got = np.diff(plan.bases, axis=0)
    assert (got >= 0).all() and got.sum(axis=0).tolist() == [5000, 20_000, 300]
    for queue, total in enumerate([5000, 20_000, 300]):
        window, at, offset = plan.cuts(queue, 0, total)
        assert (np.diff(at) >= 0).all() and at[0] == 0 and len(set(window.tolist())) == len(window) and (offset >= 0).all()
    first = plan.drawn(plan.quanta[0], np.arange(4))
    assert np.abs(first - np.arange(4)[:, None] * 1024 * np.array([0.5, 0.3, 0.2])).max() < 1


def test_mixture_argument(sample):
    docs = sample["documents"]
    sources = [r.source for r in docs.select("source").distinct().collect()]
    pieces = packing.pack(docs, mixture={s: (5.0 if s == sources[0] else 1.0) for s in sources}).collect()
    head = [p for p in pieces if p.sequence_id == 0]
    assert abs(sum(p.length for p in head if p.source == sources[0]) - 1024 * 5 / (len(sources) + 4)) < 2


def windows_of(pieces):
    """{window: {source: ids}}; every window is filled without gaps."""
    out, at = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
        own = out.setdefault(p.sequence_id, {})
        own[p.source] = own.get(p.source, 0) + p.length
    return out


@pytest.mark.parametrize("large", [0, 2])
def test_packing_mixes_small_sources(spark, large):
    rows = [(i, f"tail{i % 600}" if i % 600 else None, "some words of a small source " * (2 + i % 3)) for i in range(1800)]
    rows += [(10_000 + i, f"large{i % 2}", "words of a large source " * 5000) for i in range(10 * large)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3), with_ids=True).collect()
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == len(whole.setdefault(p.doc_id, b"")) // 4
        whole[p.doc_id] += p.ids
    assert whole == {i: np.array([*exact(t), 0], "<u4").tobytes() for i, _, t in rows}
    total, share = sum(p.length for p in pieces), {}
    for p in pieces:
        share[p.source] = share.get(p.source, 0) + p.length
    drawn, windows = dict.fromkeys(share, 0), windows_of(pieces)
    full = [w for w in sorted(windows) if sum(windows[w].values()) == 1024]
    assert len(full) == total // 1024
    for k, w in enumerate(full, 1):
        for s in share:
            drawn[s] += windows[w].get(s, 0)
            assert abs(drawn[s] - k * 1024 * share[s] / total) < 3


def test_mixture_names_small_sources(spark):
    rows = [(i, "large", "words of a large source " * 4000) for i in range(12)] + [(100, "up", "a few words " * 40), (101, "down", "a few words " * 30), (102, "rest", "unnamed")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    windows = windows_of(packing.pack(docs, mixture={"large": 0.9, "up": 0.1, "down": 0.0005}).collect())
    assert all(abs(windows[w].get("up", 0) - 1024 * 0.1 / 1.0005) < 2 for w in (0,))
    assert abs(sum(windows[w].get("down", 0) for w in range(40)) - 40 * 1024 * 0.0005) < 4
    with pytest.raises(ValueError):
        packing.pack(docs, mixture={"up": 0.0})


def test_schedule_under_one_id_a_window():
    totals, weights = [500_000, 40, 700, 9], [0.99, 0.0002, 0.009, 0.00001]
    plan = packing.Schedule(totals, weights, 1024)
    got = np.diff(plan.bases, axis=0)
    assert (got >= 0).all() and got.sum(axis=0).tolist() == totals
    steps = np.diff(plan.drawn(plan.quanta[0], np.arange(400)), axis=0)
    assert (steps >= 0).all() and (steps.sum(axis=1) == 1024).all()
    seen = set()
    for queue, total in enumerate(totals):
        seen |= set(zip(*(x.tolist() for x in plan.places(queue, np.arange(total))), strict=True))
    assert len(seen) == sum(totals)
