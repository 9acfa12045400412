"""Packing and encoding against the tokenizers library and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexmill.llm import bpe, encoding, packing
from tests_data import EDGE_ROWS, EDGE_SCHEMA

ALPHABET = ["a", "B", "é", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "23", "½", "!", "?*", "\x85", "\xa0", "\x1c", "—", "<|endoftext|>", "<|", "ß", "İ", "Σ", "中", "é", "²", "_", "\x00", "٣", "🙂", "the", "ing"]


def noise(rnd, most, alphabet=ALPHABET):
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(most)))


@pytest.mark.parametrize("name", [packing.VOCABULARY, encoding.VOCABULARY])
def test_ids_equal_the_library(name):
    ours, rnd = bpe.load(bpe.public_path(name)), random.Random(5)
    library = Tokenizer.from_file(bpe.public_path(name))
    for _ in range(4000):
        text = noise(rnd, 30)
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_tree_concatenation_is_exact():
    e, rnd = bpe.load(bpe.public_path(encoding.VOCABULARY)), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(400):
        text = noise(rnd, 400) if k % 2 else noise(rnd, 3000, letters)
        parts = [encoding.leaf(e, t) for t in encoding.halves(text, rnd.randrange(1, 60) if k % 2 else 300)]
        assert b"".join(encoding.tree(e, parts).ids) == e.packed(text), text


def test_encode_decode_rows(spark, monkeypatch):
    library = Tokenizer.from_file(bpe.public_path(encoding.VOCABULARY))
    docs = spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
    want = []
    for doc, text, *_ in EDGE_ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    for sizes in ({}, {"leaf_chars": 50}, {"leaf_chars": 20, "share": 50}):
        assert sorted(map(tuple, encoding.encode_decode(docs, **sizes).collect())) == sorted(want)
    assert encoding.encode_decode(docs.limit(0)).count() == 0


def test_leaf_borders_of_a_long_text(spark):
    # characters times leaves go beyond 32 bits
    text = "".join(random.Random(9).choice("aé中 z🙂") for _ in range(100_000))
    ids = Tokenizer.from_file(bpe.public_path(encoding.VOCABULARY)).encode(text, add_special_tokens=False).ids
    got = encoding.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), leaf_chars=4, share=4, ids=True).collect()
    assert [r.ids for r in got] == [ids]


def test_packing_rows(spark):
    library = Tokenizer.from_file(bpe.public_path(packing.VOCABULARY))
    docs = spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
    rows = packing.best_fit_packing(docs, capacity=64).collect()
    want = []
    for doc, text, *_ in EDGE_ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want.append((doc, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    assert_packed([(r.sequence_id, r.offset, r.length) for r in rows], 64)
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


def assert_packed(places, capacity):
    by: dict = {}
    for s, o, n in places:
        by.setdefault(s, []).append((o, n))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def fewest(sizes, capacity):
    """Brute force: the fewest bins."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, bins[:i] + [bins[i] + sizes[k]] + bins[i + 1 :])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def check_reduction(sizes, capacity):
    counts = Counter(sizes)
    fixed = packing.reduce_dominated(counts, capacity)
    rest = list(counts.elements())
    assert Counter(rest) + Counter([s for n, items in fixed for s in items * n]) == Counter(sizes)
    assert all(sum(items) <= capacity for _, items in fixed)
    assert sum(n for n, _ in fixed) + fewest(rest, capacity) == fewest(sizes, capacity), sizes


def test_reduction_never_costs_a_bin():
    rnd = random.Random(7)
    check_reduction([10, 10, 8, 7, 7, 7, 7, 6, 5, 4], 24)
    check_reduction([12, 8, 8, 7, 7, 6, 6, 6, 6, 5, 5, 4], 20)
    for k in range(4000):
        if k % 2:
            check_reduction([rnd.randrange(1, 31) for _ in range(rnd.randrange(1, 9))], 30)
        else:
            capacity = rnd.randrange(18, 40)
            check_reduction([rnd.randrange(capacity // 6, capacity // 2 + 2) for _ in range(rnd.randrange(6, 13))], capacity)


def test_reduction_goes_on_after_an_item_without_a_rule():
    counts = Counter({1: 5, 2: 3, 100: 10**9, 1948: 10**9, 700: 4 * 10**8, 900: 3 * 10**8})
    fixed = packing.reduce_dominated(counts, 2048)
    assert (10**9, (1948, 100)) in fixed and len(fixed) < 10


def test_plan_places_every_rank_once():
    rnd = random.Random(8)
    for _ in range(100):
        sizes = [rnd.choice([1, 2, 5, 11, 12, 20, 29, 30, rnd.randrange(1, 31)]) for _ in range(rnd.randrange(1, 400))]
        counts, places = Counter(sizes), []
        for s, seg in packing.plan(counts, 30).items():
            seg = seg[np.argsort(seg[:, 0], kind="stable")]
            ends = [*seg[1:, 0], counts[s]]
            places += [(q + k, o, s) for (a, q, o), b in zip(seg, ends, strict=True) for k in range(b - a)]
        assert len(places) == len(sizes)
        assert assert_packed(places, 30) <= -(-sum(sizes) // 30) * 1.25 + 1


def test_texts_reach_the_packing_in_small_batches(spark, monkeypatch):
    """A batch is held by the JVM and a worker at once, so it is bounded; the session's own limit comes back."""
    import pyarrow as pa

    from lexmill.llm import common, packing

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def rows(docs, *_):
        def count(batches):
            for b in batches:
                n = pa.array([b.num_rows] * b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([n, pa.array([0] * len(n), pa.int32()), pa.array([0] * len(n), pa.int64()), pa.array([1] * len(n), pa.int64()), n], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return docs.select("doc_id").mapInArrow(count, "doc_id long, piece int, start long, length long, ids_crc32 long")

    monkeypatch.setattr(packing, "token_pieces", rows)
    docs = spark.range(6_000).toDF("doc_id").coalesce(1)
    got = packing.best_fit_packing(docs).collect()
    assert len(got) == 6_000 and max(r["doc_id"] for r in got) == common.BATCH_ROWS
    assert spark.conf.get(key) == before
