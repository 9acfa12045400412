"""The permutation, its inverse and the shards' law."""

import zlib

import pytest
from pyspark.sql import functions as F

from lexmill.llm import sharding
from tests_data import EDGE_ROWS, EDGE_SCHEMA


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 5003])
def test_permutation_and_inverse(spark, n):
    x = F.col("id")
    rows = spark.range(n).select("id", sharding.permuted(x, n).alias("at"), *[c.alias(a) for c, a in zip(sharding.shard_and_slot(x, n), ("shard", "slot"), strict=True)])
    rows = spark.createDataFrame(rows.collect())
    got = rows.select("id", "at", sharding.permuted(F.col("at"), n, inverse=True).alias("back"), sharding.row_at(F.col("shard"), F.col("slot"), n).alias("row")).collect()
    assert sorted(r["at"] for r in got) == list(range(n))
    assert all(r["back"] == r["id"] == r["row"] for r in got)
    if n > 90:
        assert sum(abs(r["at"] - r["id"]) for r in got) > n * n / 6


def test_rows_law(spark):
    docs = spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
    got = sharding.feistel_sharding(docs, shards=4).collect()
    text = {(r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in EDGE_ROWS}
    assert {(r.doc_id, r.text_crc32, r.size) for r in got} == text and len(got) == len(EDGE_ROWS)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.feistel_sharding(docs.repartition(5), shards=4).collect()
    key = lambda r: (r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert sharding.feistel_sharding(docs.limit(0)).count() == 0


def test_numbers_do_not_depend_on_buckets_being_one(spark):
    rows, n = sharding.numbered(spark.range(1000).withColumnRenamed("id", "doc_id").repartition(4), ["doc_id"], bucket_rows=50)
    assert n == 1000 and sorted(r.row_number for r in rows.collect()) == list(range(1000))
