"""Exact top-k by inner product: best-first search in M-trees.

Inner products become distances by one more component: with M the largest squared norm, sqrt(M - |x|^2) for a row and 0
for a query make the squared distance |q|^2 + M - 2 q.x, so the nearest rows are those of the highest products. The index
has two levels across tasks and more inside them: rows are dealt to the nearest of the routing objects, which grow with
the rows to ``PIVOTS``; their balls (covering radius) are pruned for a query by the score of its k-th row so far. A ball
is a page; only where a ball has more rows than a page may, it is dealt out in several. A page is an M-tree whose nodes
keep routing objects, covering radii and distances to the parent. Queries are sent to pages, first to the nearest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed

SCALE = 1024
K = 10
QUERY_STEP = 100
#: Routing objects of the top level; a sample of rows by hash. Every row is indexed.
PIVOTS = 1_024
#: Rows of a page for which a routing object is added, and rows of a page at most.
BALL_ROWS, PAGE_ROWS = 4_096, 16_384
#: Queries that a page's task takes at once.
QUERY_ROWS = 32_768
FANOUT, LEAF_ROWS = 16, 256
#: Sums of integers are exact in floating point below this product of norms.
EXACT = float(1 << 52)
#: Scores beyond a long count as the nearest long.
LONG = (1 << 63) - 1


class MTree:
    """A page's tree over integer vectors. ``extra`` is the component that makes products distances."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, largest: float):
        self.x, self.ids, self.rows, self.largest = vectors, ids, rows, largest
        self.points = np.column_stack([vectors.astype("f8"), _extra(vectors, largest)])
        self.norms = np.linalg.norm(vectors.astype("f8"), axis=1)
        self.computed = 0
        self.root = self._build(np.arange(len(vectors)), 0) if len(vectors) else None

    def _build(self, members: np.ndarray, center: int) -> dict:
        """A node: routing object, covering radius, and either leaf entries or children, each with its distance to it."""
        away = np.linalg.norm(self.points[members] - self.points[center], axis=1)
        node = {"center": center, "radius": float(away.max())}
        if len(members) <= LEAF_ROWS:
            return node | {"members": members, "away": away}
        if node["radius"] == 0:  # equal vectors: pages of them
            parts = [(int(p[0]), p) for p in np.array_split(members, -(-len(members) // LEAF_ROWS))]
        else:
            # routing objects: the center, then whatever is farthest from those chosen
            chosen, near = [center], away.copy()
            while len(chosen) < FANOUT and near.max() > 0:
                chosen.append(int(members[int(near.argmax())]))
                near = np.minimum(near, np.linalg.norm(self.points[members] - self.points[chosen[-1]], axis=1))
            distances = _apart(self.points[members], self.points[chosen])
            nearest = distances.argmin(axis=1)
            parts = [(c, members[nearest == k]) for k, c in enumerate(chosen) if (nearest == k).any()]
        children = [self._build(m, c) for c, m in parts]
        centers = np.array([c["center"] for c in children])
        return node | {"children": children, "centers": centers, "radii": np.array([c["radius"] for c in children]), "apart": np.linalg.norm(self.points[centers] - self.points[center], axis=1)}

    def search(self, query: np.ndarray, own_row: int, k: int, floor: float) -> list[tuple[int, int, int]]:
        """(score, id, row) of the k best rows but the query's own, ties to smaller ids; scores below ``floor`` may lack.

        Nodes are taken by their smallest possible distance. A child, or a leaf's entry, whose stored distance to the
        parent already shows it to be too far isn't computed.
        """
        if self.root is None:
            return []
        q = np.append(query.astype("f8"), 0.0)
        length = float(np.linalg.norm(q))
        square = float(q @ q) + self.largest
        slack = 1e-9 * (np.sqrt(square) + 1)
        scores, rows, least = np.zeros(0, "i8"), np.zeros(0, "i8"), floor  # the best so far, in order
        d = float(np.linalg.norm(q - self.points[self.root["center"]]))
        heap, n = [(max(0.0, d - self.root["radius"]), 0, self.root, d)], 0
        limit = float(np.sqrt(max(0.0, square - 2 * least))) + slack if least > -np.inf else np.inf
        while heap:
            near, _, node, d = heapq.heappop(heap)
            if near > limit:
                break
            if "members" in node:
                members = node["members"]
                if limit < np.inf:
                    members = members[np.abs(d - node["away"]) <= limit]
                self.computed += len(members)
                found = _products(self.x[members], q[:-1], self.norms[members] * length)
                better = (found >= least) & (self.rows[members] != own_row)
                if not better.any():
                    continue
                scores, rows = np.concatenate([scores, found[better]]), np.concatenate([rows, members[better]])
                by = np.lexsort((self.rows[rows], self.ids[rows], -scores))[:k]
                scores, rows = scores[by], rows[by]
                if len(rows) == k:
                    least = max(floor, float(scores[-1]))
                    limit = float(np.sqrt(max(0.0, square - 2 * least))) + slack
                continue
            may = np.flatnonzero(np.abs(d - node["apart"]) - node["radii"] <= limit)
            self.computed += len(may)
            away = np.linalg.norm(self.points[node["centers"][may]] - q, axis=1)
            bounds = np.maximum(0.0, away - node["radii"][may])
            for c, a, bound in zip(may.tolist(), away.tolist(), bounds.tolist(), strict=True):
                if bound <= limit:
                    n += 1
                    heapq.heappush(heap, (bound, n, node["children"][c], a))
        return list(zip(scores.astype("i8").tolist(), self.ids[rows].tolist(), self.rows[rows].tolist(), strict=True))


def _products(x: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers with one: by floating point where ``most`` bounds them, else by Python's integers."""
    large = most >= EXACT
    if not large.any():
        return (x @ q).astype("i8")
    out = np.empty(len(x), "i8")
    out[~large] = x[~large] @ q
    whole = [int(v) for v in q.tolist()]
    for i in np.flatnonzero(large).tolist():
        out[i] = max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(x[i].tolist(), whole, strict=True))))
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all of a to all of b."""
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def _extra(vectors: np.ndarray, largest: float) -> np.ndarray:
    x = vectors.astype("f8")
    return np.sqrt(np.maximum(0.0, largest - np.einsum("ij,ij->i", x, x)))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, x: floor(scale * component), as doubles, of each vector without null and non-finite components."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  larger ones have no fraction, and may exceed a long
    x = F.transform(e, lambda v: whole(F.lit(scale) * v.cast("double")))
    return vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def mtree_topk(vectors: DataFrame, is_query: Column | None = None, k: int = K, pivots: int = PIVOTS, page_rows: int = PAGE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products among all other rows.

    Ties go to the smaller vec_id; fewer rows give fewer ranks. Null vectors and those with null or non-finite
    components take no part; shorter vectors count as padded with zeros; rows that repeat an id are rows of their own
    (and queries of their own); rows with a null id take no part; an empty table gives no rows. Components may be of any
    finite size; a score that exceeds a long counts as the nearest long.
    """
    is_query = F.col("vec_id") % QUERY_STEP == 0 if is_query is None else is_query
    rows = checkpointed(integer_vectors(vectors).where("vec_id IS NOT NULL"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    n, dims, largest = rows.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    if not n or not dims:
        return empty
    largest = float(largest)
    chosen = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(max(1, min(pivots, -(-n // min(BALL_ROWS, page_rows))))).toPandas()
    centers = _matrix(chosen["x"], dims)
    centers = np.column_stack([centers.astype("f8"), _extra(centers, largest)])

    def deal(frames):
        for pdf in frames:
            x = _matrix(pdf["x"], dims)
            points = np.column_stack([x.astype("f8"), _extra(x, largest)])
            d = _apart(points, centers)
            best = d.argmin(axis=1)
            yield pdf.assign(pivot=best, away=d[np.arange(len(d)), best])

    dealt = checkpointed(rows.mapInPandas(deal, "row long, vec_id long, x array<double>, pivot long, away double"))
    # one row for each pivot: bounded by their number
    balls = {int(r[0]): (int(r[1]), float(r[2])) for r in dealt.groupBy("pivot").agg(F.count("*"), F.max("away")).collect()}
    pages_of = {p: max(1, -(-c // page_rows)) for p, (c, _) in balls.items()}
    pages = F.create_map(*[v for p, c in pages_of.items() for v in (F.lit(p).cast("long"), F.lit(c))])
    queries = rows.where(is_query)
    parts = max(1, -(-queries.count() // query_rows))
    data = dealt.withColumn("page", F.pmod(F.xxhash64("row"), F.element_at(pages, F.col("pivot"))).cast("int")).drop("away")
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    reach = {p: r for p, (_, r) in balls.items()}
    slack = 1e-6 + 1e-7 * np.sqrt(largest)  # distances from products are less exact near 0

    def route(first: bool):
        """Sends queries with a floor to the ball they lie nearest to, or to all others that may hold a better row."""

        def to(frames):
            for pdf in frames:
                x = _matrix(pdf["x"], dims)
                points = np.column_stack([x.astype("f8"), np.zeros(len(x))])
                d = _apart(points, centers)
                there = np.array(sorted(reach))
                bound = np.maximum(0, d[:, there] - np.array([reach[p] for p in there.tolist()]))
                home = d[:, there].argmin(axis=1)
                out = []
                for i, (floor, norm) in enumerate(zip(pdf["floor"].tolist(), (points**2).sum(1).tolist(), strict=True)):
                    limit = np.inf if floor != floor or floor is None else np.sqrt(max(0.0, norm + largest - 2 * floor)) * (1 + 1e-9) + slack
                    go = [home[i]] if first else [j for j in np.flatnonzero(bound[i] <= limit) if j != home[i]]
                    out += [(i, int(there[j]), p) for j in go for p in range(pages_of[int(there[j])])]
                at = [o[0] for o in out]
                yield pdf.iloc[at].assign(pivot=[o[1] for o in out], page=np.array([o[2] for o in out], "i4"))

        return to

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_row", "query_id", "vec_id", "row", "score"]).astype("int64")
        tree = MTree(_matrix(left["x"], dims), left["vec_id"].to_numpy(), left["row"].to_numpy(), largest)
        found = []
        for row, qid, q, floor in zip(right["row"].tolist(), right["vec_id"].tolist(), _matrix(right["x"], dims), right["floor"].tolist(), strict=True):
            found += [(row, qid, i, r, s) for s, i, r in tree.search(q, row, k, -np.inf if floor != floor or floor is None else floor)]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "row", "score"], dtype="int64")

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInPandas(route(first), "row long, vec_id long, x array<double>, part int, floor double, pivot long, page int")
        keys = ["pivot", "page", "part"]
        return data.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(look, "query_row long, query_id long, vec_id long, row long, score long")

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    top = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = checkpointed(top(searched(queries.withColumn("floor", F.lit(None).cast("double")), True)))
    floors = near.where(F.col("rank") == k).select(F.col("query_row").alias("_q"), F.col("score").cast("double").alias("floor"))
    asked = queries.join(floors, F.col("row") == F.col("_q"), "left").select("row", "vec_id", "x", "part", "floor")
    every = near.drop("rank").unionByName(searched(asked, False))
    return top(every).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {QUERY_STEP} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM k WHERE n <= {K}
"""
