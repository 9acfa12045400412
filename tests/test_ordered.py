"""Greedy bins over segments against one loop a group."""

import random

import pytest

from lexmill.operators import ordered


def model(sizes, capacity, most):
    out = []
    for n in sizes:
        if out and out[-1][1] + n <= capacity and out[-1][0] < most:
            out[-1] = (out[-1][0] + 1, out[-1][1] + n)
        else:
            out.append((1, n))
    return out


@pytest.mark.parametrize(("segment", "capacity", "most"), [(7, 20, 4), (50, 20, None), (33, 500, 1000), (10_000, 20, 4), (9, 0, 3)])
def test_segments_of_any_size_give_one_loops_bins(spark, segment, capacity, most):
    rnd = random.Random(segment)
    rows = [(g, i, rnd.choice([0, 0, 1, 3, 5, 8, 40, None]), "x") for g, n in (("a", 300), ("b", 2), (None, 40), ("c", 1), ("d", 60)) for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc int, n int, `group` string")
    out = ordered.greedy_bins(df, "source", "doc", "n", capacity, most, segment_rows=segment).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.batch):
        assert len(got.setdefault(r.source, [])) == r.batch
        got[r.source].append((r.rows, r.bytes))
    by = {}
    for g, i, n, _ in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append(n or 0)
    assert got == {g: model(s, capacity, most or 1 << 60) for g, s in by.items()}


def test_no_rows(spark):
    assert ordered.greedy_bins(spark.createDataFrame([], "a string, b int, c int"), "a", "b", "c", 5, 2).count() == 0
