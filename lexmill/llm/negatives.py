"""Hard negatives by exact windows of inner products, over product-quantised rows.

Each row is cut into parts of ``PART`` components; a part is stored as the number of its nearest codeword and the norm of what
the codeword leaves. For an anchor, a table of its products with every codeword gives a row's score by one lookup a part, and
the products of part norms and residual norms bound how far the true score may lie from it (Cauchy-Schwarz). Rows whose
interval can't reach the best so far, or the window, are passed over; what remains is scored again in exact integers.
Codewords are fitted to a bounded sample; every row is encoded, and no bound depends on how well they fit.

Anchors meet rows in tiles of a bounded size on both sides. A tile returns an anchor's best few, so what is merged
afterwards follows the number of tiles. A first pass finds the positives, a second one the windows below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed

SCALE, ANCHOR_STEP = 256, 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
#: Components of a part, codewords of a part, rows they are fitted to, rounds of fitting.
PART, WORDS, SAMPLE_ROWS, ROUNDS = 4, 256, 8_192, 8
#: Rows of a tile on each side at most; rows of a tile at least; tiles across while they stay above that.
TILE_ROWS, TILE_LEAST, TILES = 65_536, 2_048, 64
#: Anchors and rows that are bounded at once inside a tile.
STEP_ANCHORS, STEP_ROWS = 256, 4_096
#: Pairs are scored one by one where fewer than this part of all is left.
DENSE = 64
#: Floating point sums of integers are exact below this product of norms.
EXACT = float(1 << 52)
LONG = (1 << 63) - 1


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "f8").reshape(len(blobs), -1)


def fitted_codewords(sample: np.ndarray, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, words, PART) codewords of a sample whose width is a multiple of PART."""
    out = []
    for part in np.split(sample, sample.shape[1] // PART, axis=1):
        centers = part[np.linspace(0, len(part) - 1, min(words, len(part))).astype(int)].copy()
        for _ in range(rounds):
            at = _nearest(part, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, at, part)
            count = np.bincount(at, minlength=len(centers))[:, None]
            centers = np.where(count > 0, sums / np.maximum(count, 1), centers)
        out.append(centers)
    return np.stack(out)


def _nearest(part: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1)[None] - 2 * part @ centers.T).argmin(axis=1)


def encoded(x: np.ndarray, codewords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes and residual norms of each row's parts; the norms hold a margin for rounding in the scores."""
    parts = np.split(x, len(codewords), axis=1)
    codes = np.stack([_nearest(p, c) for p, c in zip(parts, codewords, strict=True)], axis=1)
    left = np.stack([np.linalg.norm(p - c[codes[:, m]], axis=1) for m, (p, c) in enumerate(zip(parts, codewords, strict=True))], axis=1)
    own = np.stack([np.linalg.norm(p, axis=1) for p in parts], axis=1)
    return codes.astype("u1"), left * (1 + 1e-9) + own * 1e-9


def bounds(anchors: np.ndarray, codes: np.ndarray, left: np.ndarray, codewords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each anchor's products with each row."""
    score = np.zeros((len(anchors), len(codes)))
    norms = np.empty((len(anchors), len(codewords)))
    for m, part in enumerate(np.split(anchors, len(codewords), axis=1)):
        score += (part @ codewords[m].T)[:, codes[:, m]]
        norms[:, m] = np.linalg.norm(part, axis=1)
    off = norms @ left.T + 1e-6
    return score - off, score + off


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of integers, pair by pair; what exceeds a long is the nearest long."""
    out = np.empty(len(a), "i8")
    small = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1) < EXACT
    out[small] = np.einsum("ij,ij->i", a[small], b[small])
    for k in np.flatnonzero(~small).tolist():
        out[k] = max(-LONG, min(LONG, sum(int(x) * int(y) for x, y in zip(a[k].tolist(), b[k].tolist(), strict=True))))
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest; -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, -k, axis=1)[:, -k]


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's first k by score, then id, then row."""
    order = np.lexsort((rows, ids, -score, owner))
    o = owner[order]
    starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
    return order[np.arange(len(o)) - np.repeat(starts, np.diff(np.r_[starts, len(o)])) < k]


class Tile:
    """A tile's rows: of equal vectors under one label only the first few can ever be among the first ``k``."""

    def __init__(self, pdf: pd.DataFrame, k: int):
        pdf = pdf.sort_values(["vec_id", "row"]).groupby(["label", "x"], sort=False).head(k)
        self.row, self.ids, self.label = (pdf[c].to_numpy("i8") for c in ("row", "vec_id", "label"))
        self.x, self.left = _matrix(pdf["x"]), _matrix(pdf["left"])
        self.codes = np.frombuffer(b"".join(pdf["codes"]), "u1").reshape(len(pdf), -1)

    def steps(self) -> Iterator[slice]:
        return (slice(i, i + STEP_ROWS) for i in range(0, len(self.row), STEP_ROWS))


def first_of_own_label(tile: Tile, pdf: pd.DataFrame, codewords: np.ndarray, k: int) -> pd.DataFrame:
    """(anchor, positive_row, positive_id, positive_score): each anchor's first k other rows of its label in the tile."""
    x, row, label = _matrix(pdf["x"]), pdf["row"].to_numpy("i8"), pdf["label"].to_numpy("i8")
    found = [np.zeros((4, 0), "i8")]
    for own in np.unique(label):
        there = np.flatnonzero(tile.label == own)
        all_of_label = np.flatnonzero(label == own)
        for i in range(0, len(all_of_label) if len(there) else 0, STEP_ANCHORS):
            a = all_of_label[i : i + STEP_ANCHORS]
            least, held = np.full(len(a), -np.inf), np.zeros((4, 0), "i8")
            for j in range(0, len(there), STEP_ROWS):
                r = there[j : j + STEP_ROWS]
                low, high = bounds(x[a], tile.codes[r], tile.left[r], codewords)
                self_ = row[a][:, None] == tile.row[r][None]
                low[self_], high[self_] = -np.inf, -np.inf
                least = np.maximum(least, _kth(low, k))
                at, to = np.nonzero((high >= least[:, None]) & ~self_)
                held = np.concatenate([held, [row[a][at], tile.row[r][to], tile.ids[r][to], _scores(x[a], at, tile.x[r], to)]], axis=1)
                held = held[:, _best(held[0], held[3], held[2], held[1], k)]
                least = np.maximum(least, _floors(held[0], held[3], row[a], k))
            found.append(held)
    return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["anchor", "positive_row", "positive_id", "positive_score"])


def _scores(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Exact products of the pairs (at, to); where many pairs are asked for, by one product of both sides, in floats that are exact."""
    if len(at) * DENSE >= len(a) * len(b) > 0 and np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() < EXACT:
        return (a @ b.T)[at, to].astype("i8")
    return np.concatenate([np.zeros(0, "i8"), *(products(a[at[i : i + step]], b[to[i : i + step]]) for i in range(0, len(at), step))])


def _floors(owner: np.ndarray, score: np.ndarray, owners: np.ndarray, k: int) -> np.ndarray:
    """The k-th score that each of ``owners`` holds so far; -inf with fewer."""
    full = {}
    for o, s in zip(owner.tolist(), score.tolist(), strict=True):
        full.setdefault(o, []).append(s)
    return np.array([min(full[o]) if len(full.get(o, ())) >= k else -np.inf for o in owners.tolist()])


def first_in_windows(tile: Tile, pdf: pd.DataFrame, codewords: np.ndarray, k: int) -> pd.DataFrame:
    """(anchor, nth, negative_row, negative_id, negative_score): for each window the tile's first k rows of other labels in it.

    ``pdf`` has an anchor's windows as lists of least and most scores.
    """
    x, row, label = _matrix(pdf["x"]), pdf["row"].to_numpy("i8"), pdf["label"].to_numpy("i8")
    width = max((len(w) for w in pdf["least"]), default=0)
    lo, hi = np.full((len(pdf), width), LONG, "i8"), np.full((len(pdf), width), -LONG, "i8")
    for n, (a, b) in enumerate(zip(pdf["least"], pdf["most"], strict=True)):
        lo[n, : len(a)], hi[n, : len(b)] = a, b
    found = [np.zeros((5, 0), "i8")]
    for i in range(0, len(pdf), STEP_ANCHORS):
        a = np.arange(i, min(len(pdf), i + STEP_ANCHORS))
        least, held = np.full((width, len(a)), -np.inf), np.zeros((5, 0), "i8")
        for s in tile.steps():
            low, high = bounds(x[a], tile.codes[s], tile.left[s], codewords)
            same = label[a][:, None] == tile.label[s][None]
            low[same], high[same] = -np.inf, -np.inf
            may = np.zeros(low.shape, bool)
            for w in range(width):
                floor, ceiling = lo[a, w][:, None].astype("f8"), hi[a, w][:, None].astype("f8")
                surely = np.where((low >= floor) & (high <= ceiling), low, -np.inf)
                least[w] = np.maximum(least[w], _kth(surely, k))
                may |= (high >= np.maximum(floor, least[w][:, None])) & (low <= ceiling)
            at, to = np.nonzero(may)
            score = _scores(x[a], at, tile.x[s], to)
            for w in range(width):
                fits = (score >= lo[a, w][at]) & (score <= hi[a, w][at])
                more = [row[a][at[fits]], np.full(fits.sum(), w), tile.row[s][to[fits]], tile.ids[s][to[fits]], score[fits]]
                held = np.concatenate([held, more], axis=1)
            held = held[:, _best(held[0] * width + held[1], held[4], held[3], held[2], k)]
            for w in range(width):
                mine = held[1] == w
                least[w] = np.maximum(least[w], _floors(held[0][mine], held[4][mine], row[a], k))
        found.append(held)
    return pd.DataFrame(np.concatenate(found, axis=1).T, columns=["anchor", "nth", "negative_row", "negative_id", "negative_score"])


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, label, x: whole numbers floor(scale * component), as doubles; rows that can't take part are left out."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    # F.floor makes longs, which large components exceed; those have no fraction
    x = F.transform(e, lambda v: _floor(F.lit(scale) * v.cast("double")))
    some = vectors.where(e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine)
    return some.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))


def _floor(v: Column) -> Column:
    return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vec_id, embedding and label.

    An anchor's positives are its first other rows of its label by score; for each, the first rows of other labels whose
    score lies from 50 to 95 hundredths of the positive's are returned, ties to the smaller vec_id. Rows with a null
    vec_id, label or vector, or a null or non-finite component, take no part. Shorter vectors count as padded with zeros.
    Rows that repeat an id are rows of their own. Scores that exceed a long count as the nearest long. Other columns don't
    matter; an empty table gives no rows.
    """
    is_anchor = F.col("vec_id") % ANCHOR_STEP == 0 if is_anchor is None else is_anchor
    rows = checkpointed(integer_rows(vectors, scale))
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    dims = -(-max(1, dims or 0) // PART) * PART
    n_anchors = rows.where(is_anchor).count()
    padded = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x")))
    rows = rows.withColumn("x", padded)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("x").toPandas()["x"]
    codewords = fitted_codewords(np.array(sample.tolist(), "f8").reshape(len(sample), dims)) if n else np.zeros((dims // PART, 1, PART))

    def encode(frames):
        for pdf in frames:
            x = np.array(pdf["x"].tolist(), "f8").reshape(len(pdf), dims)
            codes, left = encoded(x, codewords)
            yield pdf.assign(x=[v.tobytes() for v in x], codes=[v.tobytes() for v in codes], left=[v.tobytes() for v in left])

    per = lambda count: max(1, min(tile_rows, max(TILE_LEAST, -(-count // TILES))))
    blocks, parts = -(-max(n, 1) // per(n)), -(-max(n_anchors, 1) // per(n_anchors))
    index = rows.mapInPandas(encode, "row long, vec_id long, label long, x binary, codes binary, left binary")
    index = checkpointed(index.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    data = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    anchors = index.where(is_anchor).select("row", "vec_id", "label", "x", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(parts)).cast("int").alias("part"))
    anchors = anchors.toDF(*anchors.columns)  # columns of their own, as tiles are grouped with them
    asked = lambda a: a.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block", "part")
    tiles = data.groupBy("block", "part")

    def own_label(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return first_of_own_label(Tile(left, positives + 1), right, codewords, positives) if len(left) and len(right) else pd.DataFrame(columns=["anchor", "positive_row", "positive_id", "positive_score"], dtype="i8")

    def windows(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return first_in_windows(Tile(left, negatives), right, codewords, negatives) if len(left) and len(right) else pd.DataFrame(columns=["anchor", "nth", "negative_row", "negative_id", "negative_score"], dtype="i8")

    near = tiles.cogroup(asked(anchors)).applyInPandas(own_label, "anchor long, positive_row long, positive_id long, positive_score long")
    by = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = checkpointed(near.withColumn("nth", (F.row_number().over(by) - 1).cast("long")).where(F.col("nth") < positives))
    # a negative's least and most score, rounded inwards, without products that could exceed a long; below 0 no score fits
    part_of = lambda hundredths, up: F.expr(f"positive_score div 100 * {hundredths} + (positive_score % 100 * {hundredths} + {up}) div 100")
    limits = F.sort_array(F.collect_list(F.struct("nth", part_of(LEAST, 99).alias("least"), part_of(MOST, 0).alias("most"))))  # of a few positives
    limits = near.where("positive_score >= 0").groupBy("anchor").agg(limits.alias("w"))
    limits = limits.select("anchor", F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    asking = anchors.join(limits, F.col("row") == F.col("anchor")).select("row", "label", "x", "part", "least", "most")
    found = tiles.cogroup(asked(asking)).applyInPandas(windows, "anchor long, nth long, negative_row long, negative_id long, negative_score long")
    by = Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= negatives)
    out = found.join(near, ["anchor", "nth"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, br) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.nth ORDER BY s.score DESC, s.vec_id, s.br) AS rank
      FROM p JOIN s ON s.r = p.r AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score WHERE p.nth <= {POSITIVES})
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""


def relabelled(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the next of ten labels where vec_id is divisible by 7."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
