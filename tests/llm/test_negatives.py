import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import negatives as N


def brute(rows, step, scale=256):
    """By plain integers, one anchor after the other."""
    rows = [(i, v, lab, [int(np.floor(scale * float(x))) for x in e]) for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, lab, x in rows:
        if v % step:
            continue
        scored = [(max(-N.LONG, min(N.LONG, sum(a * b for a, b in zip(x, y, strict=False)))), w, j, other) for j, w, other, y in rows if j != i]
        scored.sort(key=lambda t: (-t[0], t[1], t[2]))
        for ps, p, _, _ in [t for t in scored if t[3] == lab][:5]:
            fit = [t for t in scored if t[3] != lab and 50 * ps <= 100 * t[0] <= 95 * ps][:3]
            out += [(v, p, n + 1, t[1], ps, t[0]) for n, t in enumerate(fit)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, row string, x string, codes string, part int, anchor long"


def check(spark, rows, step, **how):
    df = spark.createDataFrame([(*r, "r", "x", "c", 1, 2) for r in rows], SCHEMA)
    got = N.hard_negatives(df, F.col("vec_id") % step == 0, **how).collect()
    assert sorted(map(tuple, got)) == brute([(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for v, e, lab in rows], step)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "STEP_ROWS", 60)
    monkeypatch.setattr(N, "STEP_ANCHORS", 7)
    monkeypatch.setattr(N, "TILE_LEAST", 30)
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(n, [c + rng.gauss(0, 0.05 if seed == 1 else 0.4) for c in rng.choice(centers)], rng.randint(0, 3)) for n in range(240)]
    # a vector that a third of the rows have, ids that repeat, and rows that take no part
    rows += [(rng.randint(300, 340), centers[0], rng.randint(0, 3)) for _ in range(120)]
    rows += [(400, None, 1), (405, [0.1, None, 0.2, 0.1, 0.0, 0.0], 1), (410, [float("nan")] * 6, 1), (415, [float("inf")] * 6, 2), (420, centers[1], None), (None, centers[1], 1), (425, centers[1][:3], 1), (430, [], 2)]
    check(spark, rows, 5, tile_rows=90)


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(n, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6]) for _ in range(3)], n % 2) for n in range(60)]
    rows += [(60 + n, [rng.uniform(0.9, 1) * 10 ** e, 2.5e5, 1.0], n % 2) for n, e in enumerate([8, 8, 12, 20, 38, 38])]
    check(spark, rows, 3)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.hard_negatives(df).count() == 0
    assert N.hard_negatives(spark.createDataFrame([(50, [1.0], 1, "", "", "", 0, 0)], SCHEMA)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = np.floor(rng.normal(0, 60, (500, 16))), np.floor(rng.normal(0, 60, (40, 16)))
    words = N.fitted_codewords(x[:100], 16)
    codes, left = N.encoded(x, words)
    low, high = N.bounds(q, codes, left, words)
    true = q @ x.T
    assert (low <= true).all() and (true <= high).all()
    assert (high - low).mean() < 0.8 * 2 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)).mean()


def test_many_pairs_are_scored_at_once(monkeypatch):
    """Where bounds leave most pairs, they aren't gathered one by one; large components still are."""
    rng = np.random.default_rng(6)
    a, b = np.floor(rng.normal(0, 300, (30, 8))), np.floor(rng.normal(0, 300, (50, 8)))
    at, to = np.nonzero(rng.random((30, 50)) < 0.7)
    alone, calls = N.products, []
    monkeypatch.setattr(N, "products", lambda x, y: calls.append(len(x)) or alone(x, y))
    assert N._scores(a, at, b, to).tolist() == [sum(int(u) * int(v) for u, v in zip(a[p], b[q], strict=True)) for p, q in zip(at, to, strict=True)]
    assert calls == []
    big = np.vstack([a[:-1], np.full(8, 2.0**50) + a[-1]])
    assert N._scores(big, at, b, to).tolist() == alone(big[at], b[to]).tolist()
    assert sum(calls) == len(at)
    assert N._scores(a, at[:0], b, to[:0]).tolist() == []
