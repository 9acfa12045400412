"""Folds along long ordered groups: rows dealt by range of (group, order), so a group of any length lies in consecutive segments."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a segment.
SEGMENT_ROWS = 65_536


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a temporary one where one machine does all."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the shared checkpoint folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table under a new path in the shared folder: computed once, read by columns as often as it is used."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segments(df: DataFrame, *order: str | Column, rows: int = SEGMENT_ROWS) -> DataFrame:
    """``df`` in the given order, a column ``part`` telling the segment; checkpointed, so that it stays in place."""
    out = checkpointed(df)
    out = out.repartitionByRange(max(1, -(-out.count() // rows)), *order).sortWithinPartitions(*order)
    return checkpointed(out).withColumn("part", F.spark_partition_id())


def runs(frames: Iterator[pd.DataFrame], key: str = "group") -> Iterator[pd.DataFrame]:
    """A partition's rows, one frame for each ``key``; nulls are a key too. One run is held at a time."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        k = pdf[key]
        new = (k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy(copy=True)
        if len(pdf):
            new[0] = True
        edges = [*np.flatnonzero(new).tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:], strict=False):
            some = pdf.iloc[a:b]
            last = held[-1][key].iloc[-1] if held else None
            if held and not (last == some[key].iloc[0] or (pd.isna(last) and pd.isna(some[key].iloc[0]))):
                yield pd.concat(held)
                held = []
            held.append(some)
    if held:
        yield pd.concat(held)


def starts_of(sizes: np.ndarray, capacity: int, most: int, start: int) -> list[int]:
    """Where greedy bins begin from ``start`` on: a bin ends before the row that would exceed the capacity or the count."""
    ends, out = np.cumsum(sizes), []
    while start < len(sizes):
        out.append(start)
        before = int(ends[start - 1]) if start else 0
        start = max(start + 1, min(start + most, int(np.searchsorted(ends, before + capacity, side="right"))))
    return out


def first_start(prefix: np.ndarray, capacity: int, most: int, size: int, count: int) -> int:
    """The first of the rows, by the sums of their sizes, that an open bin can't take; their number if it takes all."""
    return 0 if not count else max(0, min(most - count, len(prefix), int(np.searchsorted(prefix, capacity - size, side="right"))))


def greedy_bins(rows: DataFrame, group: str, order: str, size: str, capacity: int, most: int | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(group, batch, rows, bytes): each group's rows in order (ties by size), in bins closed by capacity or count.

    A row larger than the capacity gets a bin of its own. Where a segment's first bin begins depends on the bin left open
    before it, and so on back to the group's start. So each segment that may not be a group's only one states, for every row
    in which its first bin can begin (those that one bin can reach), what it leaves open and how many bins it began: the
    jumps over a segment. They are followed segment by segment, and then all segments are cut at once. A null size counts as
    0; a null group is a group; an empty table gives no rows.
    """
    most = most or 1 << 62
    kind, by = rows.schema[group].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    ordered = segments(rows.select(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), F.greatest(F.lit(0), F.coalesce(F.col(f"`{size}`"), F.lit(0))).cast("long").alias("size")), "group", "order", "size", rows=segment_rows)
    del by

    def jumps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a partition's first and last run: for every first start, sums before it and what is open at the end."""
        first, held = True, None
        for run in runs(frames):
            if first:
                yield table(run)
            first, held = False, None if first else run
        if held is not None:
            yield table(held)

    def table(run: pd.DataFrame) -> pd.DataFrame:
        sizes = run["size"].to_numpy("i8")
        ends = np.cumsum(sizes)
        reach = min(len(sizes), most, int(np.searchsorted(ends, capacity, side="right")) + 1)
        # the chain of bins from each start: those that meet share what follows, so it is looked up from the back
        last, began = np.empty(len(sizes), "i8"), np.empty(len(sizes), "i8")
        before = np.concatenate([[0], ends[:-1]])
        following = np.maximum(np.arange(len(sizes)) + 1, np.minimum(np.arange(len(sizes)) + most, np.searchsorted(ends, before + capacity, side="right")))
        for i in range(len(sizes) - 1, -1, -1):
            j = following[i]
            last[i], began[i] = (i, 1) if j >= len(sizes) else (last[j], began[j] + 1)
        reach = np.arange(reach)
        row = (run["part"].iloc[0], run["group"].iloc[0], len(sizes), ends[reach].tolist(), (ends[-1] - before[last[reach]]).tolist(), (len(sizes) - last[reach]).tolist(), began[reach].tolist(), int(ends[-1]))
        return pd.DataFrame([row], columns=["part", "group", "n", "ends", "open_size", "open_count", "began", "total"])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, size_, count, batch = [], 0, 0, -1
        for r in pdf.sort_values("part").itertuples():
            out.append((r.part, r.group, size_, count, batch))
            start = first_start(np.asarray(r.ends, "i8"), capacity, most, size_, count)
            if start >= r.n:
                size_, count = size_ + r.total, count + r.n
            else:
                size_, count, batch = int(r.open_size[start]), int(r.open_count[start]), batch + int(r.began[start])
        return pd.DataFrame(out, columns=["part", "group", "size", "count", "batch"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(frames, "run"):
            sizes, r = run["size"].to_numpy("i8"), run.iloc[0]
            size_, count, batch = (0, 0, -1) if pd.isna(r["open_count"]) else (int(r["open_size"]), int(r["open_count"]), int(r["open_batch"]))
            start = first_start(np.cumsum(sizes), capacity, most, size_, count)
            begins = starts_of(sizes, capacity, most, start)
            edges = np.array([*([0] if start else []), *begins])
            ids = batch + np.arange(len(edges)) + (0 if start else 1)
            yield pd.DataFrame({"group": [r["group"]] * len(edges), "batch": ids, "rows": np.diff([*edges, len(sizes)]), "bytes": np.add.reduceat(sizes, edges)})

    tables = checkpointed(ordered.mapInPandas(jumps, f"part int, group {kind}, n long, ends array<long>, open_size array<long>, open_count array<long>, began array<long>, total long"))
    several = tables.groupBy("group").agg(F.count("*").alias("times")).where("times > 1").select(F.col("group").alias("g"))
    spanning = tables.join(several, F.col("group").eqNullSafe(F.col("g")), "left_semi")
    entered = checkpointed(spanning.groupBy("group").applyInPandas(follow, f"part int, group {kind}, size long, count long, batch long"))
    entered = entered.select(F.col("part").alias("p"), F.col("group").alias("g"), F.col("size").alias("open_size"), F.col("count").alias("open_count"), F.col("batch").alias("open_batch"))
    held = ordered.join(entered, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")), "left").drop("p", "g")
    held = held.withColumn("run", F.concat_ws(":", F.col("part"), F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")))).sortWithinPartitions("part", "group", "order", "size")
    pieces = held.mapInPandas(cut, f"group {kind}, batch long, rows long, bytes long")
    out = pieces.groupBy("group", "batch").agg(F.sum("rows").cast("int").alias("rows"), F.sum("bytes").alias("bytes"))
    return out.select(F.col("group").alias(group), F.col("batch").cast("int").alias("batch"), "rows", "bytes")
