"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a lookup side is broadcast after it has been measured; beyond it the same join is shuffled.
BROADCAST_BYTES = 8 << 20
#: Rows of a batch of texts: the JVM and a worker hold one each, per task.
BATCH_ROWS = 2_500
#: Edges or nodes for each task of a round of components.
ROUND_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage: what ``spark.checkpoint.dir`` names; unset, a temporary one where one machine does all."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` with its lineage cut in the shared checkpoint folder; its Arrow batches have at most ``batch_rows`` rows, if given."""
    _folder(df.sparkSession)
    if batch_rows is None:
        return df.checkpoint(eager=True)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    # no limit is written as 0 or less
    conf.set(key, str(min(int(before), batch_rows) if int(before) > 0 else batch_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, before)


def gathered(df: DataFrame) -> DataFrame:
    """A checkpointed or written frame in as few tasks as its counted rows ask for, without a shuffle."""
    return df.coalesce(spread(df.count(), ROUND_ROWS))


def _bytes(name: str, kind: T.DataType) -> Column:
    """About the bytes of a row's value: the content of strings, binaries and arrays counts."""
    value = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        each = 8 * max(1, len(kind.elementType.fields)) if isinstance(kind.elementType, T.StructType) else 8
        return each * F.coalesce(F.size(value), F.lit(0)) + 8
    return F.lit(8)


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a checkpointed lookup side for broadcast if its measured bytes are few; else leaves the join to a shuffle."""
    row = sum((_bytes(f.name, f.dataType) for f in df.schema), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most else df


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once per row and gives it to ``body``; a lambda variable cannot be inlined again."""
    return F.transform(F.array(value), body)[0]


def spread(rows: int, per: int, most: int = 1 << 16) -> int:
    """A number of hash buckets that follows the rows: ``per`` rows each, between 1 and ``most``."""
    return max(1, min(most, -(-rows // per)))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is one node of it, the same for all.

    In each round every node joins its neighbour, or itself, of least hash, and what has joined becomes one node of the
    next round's edges; the hash is another one in each, so that no order of ids makes long chains, and edges inside a
    node vanish. A star or a clique is settled in one or two rounds, and rounds shrink geometrically. Minima are combined
    before the shuffle, so a hub's edges are never gathered; each round is written. Self loops keep isolated
    nodes. Empty input gives an empty result.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    # tasks follow the rows that are left, not the shuffle's partitions: each leaves files and a record of itself in every round
    n = edges.count()
    first = edges.coalesce(spread(n, ROUND_ROWS)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    e, levels = written(first.coalesce(spread(n, ROUND_ROWS))), []
    while not levels or (n := e.count()):
        by = lambda x: F.struct(F.xxhash64(F.lit(len(levels)), x).alias("h"), F.col(x).alias("label"))  # noqa: E731, B023
        tasks = spread(n, ROUND_ROWS)
        e = e.coalesce(tasks)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min(by("v")).alias("low"))
        level = checkpointed(both.select(F.col("u").alias("node"), F.least("low", by("u"))["label"].alias("label")).coalesce(2 * tasks))
        levels.append(level)
        near = sized(level)
        ends = e.where("u <> v").join(near.toDF("u", "a"), "u").join(near.toDF("v", "b"), "v").where("a <> b")
        # written, not checkpointed: a checkpoint keeps the planner's size estimate, which joins multiply from round to round
        e = written(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().coalesce(tasks))
    out = levels.pop()
    while levels:
        above = sized(checkpointed(out)).toDF("label", "_above")
        out = levels.pop().join(above, "label", "left").select("node", F.coalesce("_above", "label").alias("label"))
    return out.withColumnRenamed("label", "component")


def columns_of(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named columns by exact name, so that names with dots or clashing prefixes do no harm."""
    return [F.col(f"`{n}`") for n in names]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, reread: lineage is cut and columns can be pruned."""
    path = f"{_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
