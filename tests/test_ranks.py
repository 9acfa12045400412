"""Ranks by narrowing against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import profile, ranks


@pytest.mark.parametrize(("parts", "few"), [(2, 1), (7, 5), (1024, 4096)])
def test_values_at_ranks(spark, parts, few):
    rnd = random.Random(parts)
    rows = [(g, v, "x") for g, values in {
        "even": [float(i) for i in range(100)],
        "heavy": [rnd.choice([0.0, 1.0]) for _ in range(200)] + [10.0**rnd.randint(0, 12) for _ in range(30)],
        "one": [5.0], "same": [2.5] * 50, None: [rnd.uniform(-1, 1) for _ in range(61)], "nulls": [None, 3.0, None], "none": [None],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0],
    }.items() for v in values]
    rnd.shuffle(rows)
    n = F.col("n")
    got = ranks.values_at(spark.createDataFrame(rows, "g string, v double, by string"), "g", "v", {"lo": F.lit(1), "mid": F.floor((n + 1) / 2), "p90": F.greatest(F.lit(1), F.floor(n * 0.9)), "over": n + 1}, parts, few)
    by = {}
    for g, v, _ in rows:
        by.setdefault(g, []).extend([v] if v is not None else [])
    want = {g: (s[0], s[(len(s) + 1) // 2 - 1], s[max(1, int(len(s) * 0.9)) - 1], None) if (s := sorted(vs)) else (None,) * 4 for g, vs in by.items()}
    assert {r.g: (r.lo, r.mid, r.p90, r.over) for r in got.collect()} == want


def test_sampled_pages(spark):
    pages = spark.createDataFrame([(d, p) for d, n in ((1, 5), (2, 100), (None, 40)) for p in range(n)], "doc_id int, page int")
    got = {}
    for r in profile.sampled(pages).collect():
        got.setdefault(r.doc_id, set()).add(r.page)
    assert got[1] == set(range(5)) and len(got[2]) == 18 == len(got[None]) and {0, 1, 2, 97, 98, 99} <= got[2]
