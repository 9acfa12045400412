"""Sharding by a Feistel permutation of global row numbers. DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, let, spread

SHARDS = 8
SEED = 20_240_229
ROUNDS = 6
#: Rows numbered together in one task.
BUCKET_ROWS = 100_000


def _halves(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square grid of at least n cells."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _round(value: Column, other: Column, r: int, side: int, seed: int, sign: int) -> Column:
    mix = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), other), F.lit(side))
    return F.pmod(value + mix if sign > 0 else value - mix, F.lit(side))


def _step(k: int, a: int, b: int, seed: int, sign: int):
    if k % 2:
        return lambda p: F.struct(p["l"].alias("l"), _round(p["r"], p["l"], k, b, seed, sign).alias("r"))
    return lambda p: F.struct(_round(p["l"], p["r"], k, a, seed, sign).alias("l"), p["r"].alias("r"))


def _network(x: Column, n: int, seed: int, forward: bool) -> Column:
    """One pass of the network over the grid: a permutation of 0 .. a*b-1, whatever the round function."""
    a, b = _halves(n)
    pair = F.struct(F.pmod(x, F.lit(a)).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
    if n > 1 << 50:
        raise ValueError("row numbers beyond 2^50")
    for k in range(ROUNDS) if forward else reversed(range(ROUNDS)):
        pair = let(pair, _step(k, a, b, seed, 1 if forward else -1))
    return let(pair, lambda p: p["l"] + F.lit(a) * p["r"])


def permuted(x: Column, n: int, seed: int = SEED, inverse: bool = False) -> Column:
    """The permutation of 0 .. n-1 at x (or its inverse): the network is walked until it lands below n.

    A walk passes only cells beyond n, of which there are fewer than the square root of n plus one, and none
    twice: so small n need no bound on it, and for large n, where one cell in thousands lies beyond, 64 steps are
    never used up; should they be, the query fails rather than return a wrong slot.
    """
    a, b = _halves(n)
    beyond = a * b - n
    go = lambda v: _network(v, n, seed, not inverse)
    if not beyond:
        return go(x)
    walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(min(beyond, 64))), v, lambda at, _: F.when(at < n, at).otherwise(go(at)))
    landed = let(go(x), lambda v: F.when(v < n, v).otherwise(walk(v)))
    return let(landed, lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def shard_and_slot(row: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[Column, Column]:
    """Where global row number ``row`` of n goes: positions are dealt round-robin, so counts differ by one at most."""
    at = permuted(row, n, seed)
    return F.pmod(at, F.lit(shards)).cast("int"), F.floor(at / F.lit(shards)).cast("long")


def row_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The global row number at a shard's slot."""
    return permuted(slot.cast("long") * shards + shard, n, seed, inverse=True)


def numbered(rows: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(rows with a global ``row_number`` from 0 without gaps, their number).

    Numbers follow from the keys' values alone, not from files or partitions: hash buckets are numbered one after
    the other, and inside a bucket rows are ordered by the keys; rows equal in all keys are interchangeable.
    ``rows`` should be checkpointed, as it is read three times. Only the buckets' counts meet in one task.
    """
    n = rows.count()
    order = [F.col(f"`{k}`") for k in keys]
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(spread(n, bucket_rows))).cast("int"))
    first = F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(F.col("_bucket").alias("_b")).count().withColumn("_first", F.coalesce(first, F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    # at most 2^16 bucket counts, by the bound in spread(): always small enough to broadcast
    out = rows.withColumn("_within", within).join(F.broadcast(starts.select("_b", "_first")), F.col("_bucket") == F.col("_b"))
    return out.withColumn("row_number", (F.col("_first") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_b", "_first"), n


def feistel_sharding(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), row_number, shard, slot, grown_shard of every row.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: of those bytes. Shards' row counts are at most
    one apart. Null ids are numbered like others; rows equal in id and text take neighbouring numbers in any order;
    an empty table gives no rows; further columns play no part. grown_shard is null under this law.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])
    shard, slot = shard_and_slot(F.col("row_number"), max(n, 1), shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number", shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
