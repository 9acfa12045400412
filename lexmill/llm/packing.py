"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

A packing depends on how many pieces there are of each length, never on which: so the pieces are counted by
length (at most ``capacity`` counts reach the driver, whatever the input), the counts are packed, and the plan is
dealt back to the pieces by their rank among those of equal length. The plan's size, too, is bounded by the
capacity, not by the input.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import bpe
from lexmill.llm.common import BATCH_ROWS, checkpointed, spread

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Pieces per rank bucket: rows of one length are ranked in parallel, a bucket at a time.
RANK_ROWS = 4_096


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces.

    A document's ids are its text's (null: none), then the separator; only longer ones are cut, every ``capacity``
    ids. So an empty or null text gives one piece of one id. Repeated rows give repeated pieces.
    """
    path = path or bpe.public_path(VOCABULARY)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if ids else "")
    stop = np.array([separator], "<u4").tobytes()

    def cut(batches):
        encoder = bpe.load(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                blob = (encoder.packed(text.as_py()) if text.is_valid else b"") + stop
                doc = doc.as_py()
                for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at : at + 4 * capacity]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                    if ids:
                        cols[5].append(np.frombuffer(part, "<u4"))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: 5 + ids], types, strict=False)], names=names)
        encoder.forget()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def reduce_dominated(counts: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Takes from ``counts`` the sets that dominate every other set with their item j; (times, lengths).

    By Martello and Toth, for each item j from the largest: if nothing fits beside it, {j}; else with k the largest that
    fits: {j, k} if it fills the bin, or no second item fits beside the smallest, or the best fitting pair (r, s) isn't
    longer than k while no three fit; {j, r, s} if no three fit, r is as long as k, and no fitting pair has both items
    longer than s. Each reason outlasts the removal of items, so a set is taken as often as the counts allow. An item
    for which none holds is set aside, as an alternative for others, and the next is tried; passes end with one that
    takes nothing. The work follows the number of lengths, never the counts.
    """
    fixed: list[tuple[int, tuple[int, ...]]] = []
    while True:
        before = len(fixed)
        for j in sorted((s for s, n in counts.items() if n), reverse=True):
            while counts[j]:
                items = _dominating(counts, j, capacity)
                if items is None:
                    break
                times = min(counts[s] // n for s, n in Counter(items).items())
                fixed.append((times, items))
                for s in items:
                    counts[s] -= times
        if len(fixed) == before:
            return fixed


def _dominating(counts: Counter, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set of lengths that dominates all others with a j, if the rules name one."""
    alive = sorted((s for s, n in counts.items() if n - (s == j) > 0), reverse=True)
    room = capacity - j
    k = next((s for s in alive if s <= room), None)
    if k is None:
        return (j,)

    def least(number: int, above: int = 0) -> list[int]:
        """The smallest remaining items longer than ``above``."""
        out: list[int] = []
        for s in reversed(alive):
            if s > above and len(out) < number:
                out += [s] * min(number - len(out), counts[s] - (s == j))
        return out

    low = least(3)
    if k == room or len(low) < 2 or low[0] + low[1] > room:
        return (j, k)
    if len(low) == 3 and sum(low) <= room:
        return None  # sets of up to three items can't dominate
    r, s = _best_pair(alive, counts, j, room)
    if k >= r + s:
        return (j, k)
    between = least(2, s)
    return (j, r, s) if r == k and (len(between) < 2 or sum(between) > room) else None


def _best_pair(alive: list[int], counts: Counter, j: int, room: int) -> tuple[int, int]:
    """The two items with the largest sum that fits; the larger first."""
    best, a, b = (0, 0), 0, len(alive) - 1
    while a <= b:
        r, s = alive[a], alive[b]
        if r + s > room or a == b and counts[r] - (r == j) < 2:
            a += 1
        else:
            if r + s > sum(best):
                best = (r, s)
            b -= 1
    return best


def best_fit(counts: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts of lengths: equal bins are handled as one, so the work follows the lengths."""
    open_bins: dict[int, list[list]] = {}  # room left -> [times, items]
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            while n and open_bins.get(room):
                times, items = open_bins[room].pop()
                each = min(room // size, n)
                full = min(times, n // each)
                if times > full:
                    open_bins[room].append([times - full, items])
                open_bins.setdefault(room - each * size, []).append([full, items + (size,) * each])
                n -= full * each
            if not n:
                break
        if n:
            each = min(capacity // size, n)
            if n // each:
                open_bins.setdefault(capacity - each * size, []).append([n // each, (size,) * each])
            if n % each:
                open_bins.setdefault(capacity - n % each * size, []).append([1, (size,) * (n % each)])
        for r in [r for r, bins in open_bins.items() if not bins]:
            del open_bins[r]
    return [(times, items) for bins in open_bins.values() for times, items in bins]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length the segments of its ranks: columns first rank, first sequence id, offset in the sequence."""
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("every length must be between 1 and the capacity")
    left = Counter(counts)
    bins = reduce_dominated(left, capacity)
    bins += best_fit(left, capacity)
    segments: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for times, items in bins:
        at = 0
        for size in items:
            segments.setdefault(size, []).append((used[size], sequence, at))
            used[size] += times
            at += size
        sequence += times
    return {s: np.array(x, "i8") for s, x in segments.items()}


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset: gapless from 0 in each sequence of at most ``capacity``.

    ``keys`` order pieces of equal length (ties and repeated rows: any order among them). Empty input: empty.
    """
    if not pieces.isEmpty():
        n = pieces.count()
    else:
        n = 0
    buckets = spread(n, RANK_ROWS, 4_096)
    # a piece's columns travel in a struct, so their names can't clash with those of the plan
    order: list[Column] = [F.col(f"_piece.`{k}`") for k in keys]
    salted = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("_piece"), F.col(f"`{length}`").cast("long").alias("_length"))
    salted, length = salted.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), "_length"
    # at most capacity x buckets rows, and buckets grow by one in RANK_ROWS pieces
    tally = salted.groupBy(F.col(length).alias("_size"), "_bucket").count()
    first = F.sum("count").over(Window.partitionBy("_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    tally = checkpointed(tally.withColumn("_first", F.coalesce(first, F.lit(0))))
    counts = {int(r[0]): int(r[1]) for r in tally.groupBy("_size").agg(F.sum("count")).collect()}
    starts = {s: x[np.argsort(x[:, 0], kind="stable")] for s, x in plan(counts, capacity).items()}

    rank = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order)) - 1
    tally = tally.select("_size", F.col("_bucket").alias("_b"), "_first")
    ranked = salted.withColumn("_rank", rank).join(tally, (F.col(length) == F.col("_size")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_first")).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size, rank):
        import pandas as pd

        out = np.zeros((len(size), 2), "i8")
        sizes, ranks = size.to_numpy(), rank.to_numpy()
        by = np.argsort(sizes, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(sizes[by])) + 1) if len(by) else ():
            seg = starts[int(sizes[part[0]])]
            k = np.searchsorted(seg[:, 0], ranks[part], "right") - 1
            out[part, 0] = seg[k, 1] + ranks[part] - seg[k, 0]
            out[part, 1] = seg[k, 2]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    return ranked.withColumn("_place", place(F.col(length).cast("long"), "_rank")).select(*[F.col(f"_piece.`{c}`").alias(c) for c in pieces.columns], "_place.sequence_id", "_place.offset")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are packed as one separator; very long ones are cut; repeated rows are packed as often as
    they occur; an empty table gives no rows; further columns are not looked at.
    """
    pieces = checkpointed(token_pieces(docs, path, capacity, separator), BATCH_ROWS)
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], "length", capacity)
