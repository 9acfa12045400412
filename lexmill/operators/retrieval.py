"""Filtered vector top-k, parent merge, kind-aware candidates and round-robin merge of several queries."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexmill.config import Options
from lexmill.functions.text import boosted_kind, case_variants, is_empty_section
from lexmill.operators import ordered, vectors

FILTER_KEYS = ("year", "module", "type", "course", "source", "kind")
POOL_WITH_RERANKER = 25


def metadata_filter(meta: Mapping[str, object]) -> Column | None:
    """All given keys must match; a string matches in any of four spellings, another value exactly; none: no filter."""
    out = None
    for key in FILTER_KEYS:
        value = meta.get(key)
        if value in (None, ""):
            continue
        if isinstance(value, str):
            spellings = dict.fromkeys([value, value.upper(), value.lower(), value[:1].upper() + value[1:].lower()])
            test = F.col(key).isin(*spellings)
        else:
            test = F.col(key) == F.lit(value)
        out = test if out is None else out & test
    return out


def matches(column: Column, wanted: Column) -> Column:
    """The same test against a column of wanted values; a null or empty one filters nothing."""
    return wanted.isNull() | (wanted == "") | F.array_contains(case_variants(wanted), column)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null or has no length, or the dimensions differ."""
    scale = norm(a) * norm(b)
    return F.when((scale > 0) & (F.size(a) == F.size(b)), dot(a, b) / scale)


def search(chunks: DataFrame, queries: DataFrame, limit: int, match: Mapping[str, Column] | None = None, chunk_key: str = "chunk_id", vector: str = "vector", query_vector: str = "query_vector") -> DataFrame:
    """Exact top-k of every query: query_id, rank, ``chunk_key`` and score.

    ``match`` gives, by column of ``chunks``, the value that a query wants of it (a string in any spelling of the filter's,
    null or empty: any); it applies before ranking. Only keys and vectors are ranked: join texts afterwards.
    """
    return vectors.top_k(chunks, queries, [(limit, _accepted(chunks, match))], chunk_key, vector, query_vector).drop("heap")


def _accepted(chunks: DataFrame, match: Mapping[str, Column] | None) -> dict[str, Column]:
    return {c: vectors.accepted(wanted, dict(chunks.dtypes)[c]) for c, wanted in (match or {}).items()}


def pool_size(top_k: int, reranker: bool, with_reranker: int = POOL_WITH_RERANKER) -> int:
    return with_reranker if reranker else max(3 * top_k, 10)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    top_k: int | None = None,
    match: Mapping[str, Column] | None = None,
    reranker: Callable[[DataFrame], DataFrame] | None = None,
    parents: DataFrame | None = None,
) -> DataFrame:
    """Best parents of every query: query_id, rank, parent_id, chunk_id, score, kind and the parent's text.

    ``chunks``: chunk_id, parent_id, vector, kind (null: prose) and the columns of ``match``; ``queries``: query_id,
    query (text), query_vector and what ``match`` wants; ``parents``: parent_id, parent_text. Children are over-fetched, a
    question that asks for a kind adds that kind's own best (a second heap over the same products), the best child stands for its parent, parents that say
    nothing are dropped after the pool's cut, then the reranker (or the dense order) decides. With ``parents``, hits are
    stored before chunks and texts are joined to them, so that tables are read and not dealt out where hits are few, and
    with their texts, so that only theirs are judged.
    """
    options = Options.of(chunks.sparkSession)
    top_k = options.top_k if top_k is None else top_k
    pool = pool_size(top_k, reranker is not None, options.rerank_pool)
    wanted = _accepted(chunks, match)
    asked = F.coalesce(F.array(boosted_kind(F.col("query"))), F.array().cast("array<string>"))
    asked = F.filter(asked, lambda k: k.isNotNull())  # no kind asked for: nothing is accepted
    of_kind = F.when(wanted["kind"].isNull(), asked).otherwise(F.array_intersect(wanted["kind"], asked)) if "kind" in wanted else asked
    both = vectors.top_k(chunks, queries, [(4 * max(pool, top_k), wanted), (max(4, top_k), wanted | {"kind": of_kind})])
    kept = ordered.written if parents is not None else lambda df, name: df
    both = kept(both, "hits")
    # a row that only the second heap has comes after all of the first, so a parent's best is the first heap's if that has any
    hits = both.join(chunks.select("chunk_id", "parent_id", F.coalesce("kind", F.lit("prose")).alias("kind")), "chunk_id").drop("heap", "rank")
    best = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("score"), "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    merged = hits.where("parent_id IS NOT NULL").withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("_pool", F.row_number().over(order)).where(F.col("_pool") <= pool)
    if parents is not None:
        merged = kept(kept(merged, "pool").join(parents.select("parent_id", "parent_text"), "parent_id"), "texts").where(~is_empty_section(F.col("parent_text")))
    if reranker is not None:
        merged = reranker(merged)
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "_pool")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.drop("_n", "_pool")


def round_robin(ranked: DataFrame, most: int | None = None, by: str = "query_index", parent: str = "parent_id", group: list[str] | None = None) -> DataFrame:
    """Several queries' results as one: by rank, then by query; a parent counts once; at most ``most`` rows a group (the session's option unless given)."""
    group, most = group or [], Options.of(ranked.sparkSession).most_many if most is None else most
    first = Window.partitionBy(*group, parent).orderBy("rank", by)
    order = Window.partitionBy(*group).orderBy("rank", by) if group else Window.orderBy("rank", by)
    once = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if not group:
        once = once.orderBy("rank", by).limit(most)  # a take-ordered plan: no single task sees all rows
    return once.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def embed_hashed(text: Column, dims: int = 64) -> Column:
    """The offline stand-in of an embedding model: a unit vector of hashed words. Same text, same vector.

    As a model would be, it is a batched function of its own, so a plan computes a text's vector once.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            counts = [0.0] * dims
            for word in re.findall(r"\w+", (t or "").lower()):
                counts[zlib.crc32(word.encode()) % dims] += 1
            length = math.sqrt(sum(c * c for c in counts))
            return [c / length for c in counts] if length else counts

        return texts.map(one)

    return embed(text)
