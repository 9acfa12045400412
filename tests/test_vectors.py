"""Tiled top-k against plain loops: filters, several heaps, ties, hot vectors, odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import retrieval, vectors


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or any(x is None or not math.isfinite(x) for x in (*a, *b)):
        return None
    la, lb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return math.floor(abs(c := sum(x * y for x, y in zip(a, b, strict=True)) / la / lb) * 1e6 + 0.5) / 1e6 * (1 if c >= 0 else -1) if la and lb else None


def spellings(v):
    return {v, v.upper(), v.lower(), v[:1].upper() + v[1:].lower()}


def brute(chunks, queries, limit):
    out = []
    for q, qv, module, year in queries:
        fit = [(-cosine(cv, qv), c) for c, cv, m, y in chunks if cosine(cv, qv) is not None and (not module or m in spellings(module)) and (year is None or y == year)]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(fit)[:limit])]
    return sorted(out)


@pytest.mark.parametrize("tile", [64, 100_000])
def test_search_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE_LEAST", 20 if tile == 64 else 256)
    monkeypatch.setattr(vectors, "STEP_CHUNKS", 33)
    rnd = random.Random(tile)
    vec = lambda n=4: [round(rnd.uniform(-1, 1), 2) for _ in range(n)]
    hot = vec()
    chunks = [(f"c{i:03}", hot if i % 3 == 0 else vec(), rnd.choice(["Cardio", "cardio", "CARDIO", "x", None]), rnd.choice([2020, 2021, None])) for i in range(180)]
    chunks += [("z1", None, "x", 2020), ("z2", [0.0] * 4, "x", 2020), ("z3", vec(3), "x", 2020), ("z4", [1.0, None, 0.0, 0.0], "x", 2020), ("z5", [float("nan"), 1.0, 0.0, 0.0], "x", 2020), ("z6", [], "x", 2020)]
    queries = [(i, vec(3 if i == 7 else 4), rnd.choice(["cardio", "", None, "x", "none"]), rnd.choice([None, 2020])) for i in range(40)] + [(50, None, None, None), (51, [0.0] * 4, None, None)]
    c = spark.createDataFrame(chunks, "chunk_id string, vector array<double>, module string, year int")
    q = spark.createDataFrame(queries, "query_id long, query_vector array<double>, wanted string, in_year int")
    found = vectors.top_k(c, q, [(6, {"module": vectors.accepted(F.col("wanted")), "year": vectors.accepted(F.col("in_year"), "int")}), (3, {"module": F.array(F.lit("x"))})], tile_bytes=tile)
    got = sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found.where("heap = 0").collect())
    assert got == brute(chunks, queries, 6)
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in found.where("heap = 1").collect()) == brute(chunks, [(i, v, "x", None) for i, v, _, _ in queries], 3)
    alone = retrieval.search(c, q, 6, {"module": F.col("wanted"), "year": F.col("in_year")})
    assert sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in alone.collect()) == got
    assert vectors.top_k(c.limit(0), q, [(5, {})]).count() == 0 == vectors.top_k(c, q.limit(0), [(5, {})]).count()


def test_no_pairs_in_the_plan_of_many_queries(spark):
    rows = spark.range(100_000).select(F.col("id").alias("query_id"), F.array(F.rand(1), F.rand(2)).alias("query_vector"))
    plan = retrieval.search(rows.select(F.col("query_id").alias("chunk_id"), F.col("query_vector").alias("vector")), rows, 5)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "BroadcastExchange" not in plan
