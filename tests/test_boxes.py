"""The grid join against all pairs."""

import random

from pyspark.sql import functions as F

from lexmill.operators import boxes


def ratio(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    smaller = min(max(0, x[2] - x[0]) * max(0, x[3] - x[1]) for x in (a, b))
    return w * h / smaller if w > 0 and h > 0 and smaller > 0 else 0.0


def some(rnd, n):
    out = []
    for i in range(n):
        size = rnd.choice([0.01, 0.5, 1, 2, 3.7, 40])
        x, y = rnd.choice([rnd.uniform(-5, 5), rnd.randint(-4, 4)]), rnd.uniform(-5, 5)
        out.append((i, rnd.choice(["p", "q", None]), (float(x), y, float(x + size * rnd.choice([1, 1, rnd.random()])), y + size * rnd.choice([1, rnd.random(), 0])), "c"))
    out += [(n, "p", (0.0, 0.0, 1.0, 1.0), "c"), (n + 1, "p", (0.0, 0.0, 1.0, 1.0), "c"), (n + 2, "p", (1.0, 1.0, 0.0, 0.0), "c"), (n + 3, "p", (None, 0.0, 1.0, 1.0), "c"), (n + 4, "p", None, "c")]
    return out


def test_every_pair_once(spark):
    rnd = random.Random(5)
    left, right = some(rnd, 150), some(rnd, 130)
    kind = "id int, page string, box struct<x0: double, y0: double, x1: double, y1: double>, row string"
    l, r = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    whole = lambda b: b is not None and None not in b
    for least in (0.7, 1e-9):
        got = sorted((x.a, x.b, round(x.overlap, 9)) for x in boxes.overlap_join(l, r, ["page"], least).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "overlap").collect())
        want = sorted((a, b, round(ratio(x, y), 9)) for a, p, x, _ in left for b, q, y, _ in right if p and p == q and whole(x) and whole(y) and ratio(x, y) >= least)
        assert got == want and got
    assert boxes.overlap_join(l.limit(0), r, ["page"], 0.7).count() == 0


def test_far_boxes_are_not_compared(spark):
    n = 3000
    at = lambda c: (F.col(c) * 3).cast("double")
    rows = spark.range(n).select("id", F.lit(1).alias("page"), (F.col("id") % 60).alias("i"), F.floor(F.col("id") / 60).alias("j"))
    b = rows.select("id", "page", F.struct(at("i").alias("x0"), at("j").alias("y0"), (at("i") + 2).alias("x1"), (at("j") + 2).alias("y1")).alias("box"))
    cells = boxes._in_cells(boxes._levelled(b, ["page"], "box"), F.array("level"))
    assert cells.count() <= 4 * n
    assert cells.groupBy("at", "cx", "cy").count().agg(F.max("count")).first()[0] <= 4
    assert boxes.overlap_join(b, b, ["page"], 0.7).count() == n
