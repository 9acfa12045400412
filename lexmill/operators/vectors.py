"""Exact top-k by cosine in tiles: blocks of chunks against blocks of queries, as dense products in Arrow batches.

Vectors get length 1 once, on their way into a tile; a tile's scores are one matrix product, and each of its queries keeps
a heap of its best rows, or several heaps under different filters. What leaves a tile is a heap's rows, so what is merged by
query follows the number of tiles. Sides are dealt by hash into blocks of a bounded size, so neither is ever broadcast and no
pair of rows is a row of a plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import case_variants

#: Bytes of vectors on one side of a tile at most; rows at least while there are several tiles a core.
TILE_BYTES, TILE_LEAST = 32 << 20, 256
#: Queries and chunks that are multiplied at once.
STEP_QUERIES, STEP_CHUNKS = 256, 8_192


def accepted(wanted: Column, kind: str = "string") -> Column:
    """The values that a wanted one matches: a string in any of four spellings, another value exactly; null for no filter."""
    if kind != "string":
        return F.when(wanted.isNotNull(), F.array(wanted.cast("string")))
    return F.when(wanted.isNotNull() & (wanted != ""), case_variants(wanted))


def units(column: pd.Series) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By dimension: places and unit vectors. Vectors that are null, hold nulls or have no finite positive length have none."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(column):
        if v is not None and len(v):
            places, rows = by.setdefault(len(v), ([], []))
            places.append(i), rows.append(v)
    out = {}
    for dims, (places, rows) in by.items():
        x = np.array([np.asarray(r, "f8") for r in rows])
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        fine = np.isfinite(length) & (length > 0)
        out[dims] = np.array(places)[fine], x[fine] / length[fine, None]
    return out


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.sign(scores) * np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6


def _first(owner: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's first ``k`` by score, then rank."""
    order = np.lexsort((rank, -score, owner))
    o = owner[order]
    starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, int)
    return order[np.arange(len(o)) - np.repeat(starts, np.diff(np.r_[starts, len(o)])) < k]


def tile_best(chunks: pd.DataFrame, queries: pd.DataFrame, heaps: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(heap, query places, chunk places, scores): each query's first rows of a tile in each heap, ties by key.

    ``heaps``: a limit and the names of the filtered columns; a query's accepted values of column c for heap h are in ``h{h}_{c}``.
    """
    rank = np.empty(len(chunks), "i8")
    rank[chunks["key"].argsort(kind="stable").to_numpy()] = np.arange(len(chunks))
    left, right = units(chunks["vector"]), units(queries["query_vector"])
    values = {c: chunks[f"f_{c}"].to_numpy(object) for c in {c for _, names in heaps for c in names}}
    for dims in left.keys() & right.keys():
        (at, x), (asks, q) = left[dims], right[dims]
        for h, (limit, names) in enumerate(heaps):
            wanted = [tuple(None if a is None else frozenset(a) for a in w) for w in zip(*[queries[f"h{h}_{c}"].iloc[asks] for c in names], strict=True)] if names else [()] * len(asks)
            alike: dict[tuple, list[int]] = {}
            for i, w in enumerate(wanted):
                alike.setdefault(w, []).append(i)
            for w, some in alike.items():
                fits = np.ones(len(at), bool)
                for c, accept in zip(names, w, strict=True):
                    if accept is not None:
                        fits &= np.fromiter((v in accept for v in values[c][at]), bool, len(at))
                rows = np.flatnonzero(fits)
                for i in range(0, len(some) if len(rows) else 0, STEP_QUERIES):
                    mine = np.array(some[i : i + STEP_QUERIES])
                    held: tuple = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                    for j in range(0, len(rows), STEP_CHUNKS):
                        r = rows[j : j + STEP_CHUNKS]
                        s = rounded(q[mine] @ x[r].T)
                        enough = np.partition(s, -limit, axis=1)[:, -limit] if s.shape[1] > limit else np.full(len(s), -np.inf)
                        a, b = np.nonzero(s >= enough[:, None])
                        held = tuple(np.concatenate(p) for p in zip(held, (mine[a], r[b], s[a, b]), strict=True))
                        keep = _first(held[0], held[2], rank[at[held[1]]], limit)
                        held = tuple(p[keep] for p in held)
                    yield h, asks[held[0]], at[held[1]], held[2]


def top_k(chunks: DataFrame, queries: DataFrame, heaps: list[tuple[int, Mapping[str, Column]]], chunk_key: str = "chunk_id", vector: str = "vector", query_vector: str = "query_vector", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """query_id, heap, rank, ``chunk_key``, score: each query's first rows of each heap by cosine (6 decimals), ties by key.

    A heap has a limit and, by column of ``chunks``, the array of values that a query accepts (null: all; empty: none).
    Vectors that are null, hold nulls or have no length take no part, nor do pairs of different dimensions. Queries of one
    query_id share a heap. Empty tables give no rows.
    """
    names = sorted({c for _, match in heaps for c in match})
    dims = queries.where(F.size(query_vector) > 0).select(F.size(query_vector)).first()
    most = max(TILE_LEAST, tile_bytes // (8 * (dims[0] if dims else 1)))
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    per = lambda n, tiles: max(1, -(-n // min(most, max(TILE_LEAST, -(-n // tiles)))))
    blocks, parts = per(chunks.count(), 3 * cores), per(queries.count(), 1)
    dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns[:1]), F.lit(n)).cast("int")
    key, ask = chunks.schema[chunk_key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    left = chunks.select(F.col(chunk_key).alias("key"), F.col(vector).alias("vector"), *[F.col(c).cast("string").alias(f"f_{c}") for c in names])
    left = left.withColumn("block", dealt(left, blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.select("query_id", F.col(query_vector).alias("query_vector"), *[(match[c] if c in match else F.lit(None).cast("array<string>")).alias(f"h{h}_{c}") for h, (_, match) in enumerate(heaps) for c in names])
    right = right.withColumn("part", dealt(right, parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.toDF(*right.columns)
    limits = [(limit, names) for limit, _ in heaps]

    def tile(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        frames = [pd.DataFrame({"query_id": q["query_id"].to_numpy()[a], "heap": h, "key": c["key"].to_numpy()[b], "score": s}) for h, a, b, s in tile_best(c, q, limits)] if len(c) and len(q) else []
        return pd.concat(frames) if frames else pd.DataFrame(columns=["query_id", "heap", "key", "score"])

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(tile, f"query_id {ask}, heap int, key {key}, score double")
    order = Window.partitionBy("query_id", "heap").orderBy(F.desc("score"), "key")
    limit = F.lit(max(limit for limit, _ in heaps))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    by_heap = F.element_at(F.array(*[F.lit(n) for n, _ in heaps]), F.col("heap") + 1)
    return found.where(F.col("rank") <= by_heap).select("query_id", "heap", "rank", F.col("key").alias(chunk_key), "score")
