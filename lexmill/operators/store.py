"""The chunk table: payload, idempotent replace, delete and retag by predicate, listings, write batches, jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.config import Options
from lexmill.operators import ranks
from lexmill.operators.ordered import checkpointed, greedy_bins
from lexmill.operators.retrieval import metadata_filter

BYTES_PER_DIM = 20
TERMINAL = ("done", "failed")


def payload(chunks: DataFrame) -> DataFrame:
    """As stored: empty strings are null, and so is the kind of prose. Readers give prose back with ``stored_kind``."""
    out = chunks
    for name, kind in chunks.dtypes:
        if kind == "string":
            out = out.withColumn(name, F.nullif(F.col(f"`{name}`"), F.lit("")))
    return out.withColumn("kind", F.nullif("kind", F.lit("prose"))) if "kind" in chunks.columns else out


def stored_kind(c: Column) -> Column:
    return F.coalesce(c, F.lit("prose"))


def point_bytes(fields: list[Column], vector: Column | None = None) -> Column:
    """Estimated size of a row on the wire: characters of its values, and so many bytes a dimension."""
    size = F.lit(0)
    for f in fields:
        size = size + F.coalesce(F.length(f.cast("string")), F.lit(0))
    return (size + (F.coalesce(F.size(vector), F.lit(0)) * BYTES_PER_DIM if vector is not None else 0)).cast("bigint")


def write_batches(rows: DataFrame, group: str, order: str, size: str, capacity: int | None = None, most: int | None = None) -> DataFrame:
    """(group, batch, rows, bytes): each group's rows in order, closed by bytes or count; an oversize row goes alone.

    Both limits are the session's options unless given. A group of any length will do: its rows are never gathered.
    """
    options = Options.of(rows.sparkSession)
    return greedy_bins(rows, group, order, size, options.batch_bytes if capacity is None else capacity, options.batch_rows if most is None else most)


def replace_sources(stored: DataFrame, fresh: DataFrame, key: str = "source") -> DataFrame:
    """Re-ingest: rows of the sources that ``fresh`` brings are replaced; sources without fresh rows stay.

    Sources match in the filter's spellings: a fresh ``a.pdf`` also replaces ``A.PDF``.
    """
    from lexmill.functions.text import case_variants

    new = fresh.select(F.explode(case_variants(F.col(key))).alias(key)).distinct()
    return stored.join(new, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete_by_metadata(stored: DataFrame, meta: Mapping[str, object]) -> DataFrame:
    """Rows that don't match; with no condition nothing is deleted."""
    test = metadata_filter(meta)
    return stored if test is None else stored.where(~F.coalesce(test, F.lit(False)))


def retag(stored: DataFrame, source: str, url: str, column: str = "file_url") -> DataFrame:
    """One column set on the matching rows."""
    test = metadata_filter({"source": source})
    return stored if test is None else stored.withColumn(column, F.when(test, F.lit(url)).otherwise(F.col(column)))


def list_sources(stored: DataFrame, order: str, tags: tuple[str, ...] = ("module", "course", "year", "type"), unnamed: str = "(unnamed)") -> DataFrame:
    """One row a source: chunks, and each tag's first non-empty value by ``order``; by name without case."""
    first = [F.min_by(t, F.when(F.col(t).isNotNull() & (F.col(t) != ""), F.col(order))).alias(t) for t in tags]
    named = F.coalesce(F.nullif("source", F.lit("")), F.lit(unnamed)).alias("source")
    return stored.groupBy(named).agg(F.count("*").alias("chunks"), *first).orderBy(F.lower("source"), "source")


def source_urls(stored: DataFrame, order: str, url: str = "file_url") -> DataFrame:
    """(source, url, position): distinct non-empty urls in the order first seen."""
    first = stored.where(F.col(url).isNotNull() & (F.col(url) != "")).groupBy("source", url).agg(F.min(order).alias("_first"))
    return first.select("source", url, F.row_number().over(Window.partitionBy("source").orderBy("_first", url)).alias("position"))


def ingest_result(children: DataFrame, by: str = "source") -> DataFrame:
    return children.groupBy(by).agg(F.count("*").alias("chunks"), F.countDistinct("parent_id").alias("parents"))


def jobs(log: DataFrame, cap: int | None = None) -> DataFrame:
    """The registry that a log of (job_id, ts, status) leaves: newest first, oldest finished jobs beyond the cap evicted.

    A job's creation is its first row; later rows only update it. The cap is the session's option unless given. The last
    creation to go is found by rank, so the finished jobs are never sorted as one; only those of that very moment are.
    """
    cap = Options.of(log.sparkSession).job_cap if cap is None else cap
    state = log.groupBy("job_id").agg(F.min("ts").alias("created"), F.max("ts").alias("updated"), F.max_by("status", F.struct("ts", "status")).alias("status"))
    state = checkpointed(state)
    over = state.count() - cap
    if over > 0:
        at = F.unix_micros(F.col("created").cast("timestamp"))
        ended = state.where(F.col("status").isin(*TERMINAL)).select("job_id", at.alias("at"), F.lit(0).alias("all"))
        last = ranks.values_at(ended, "all", "at", {"last": F.least(F.lit(over), F.col("n"))}).first()
        if last is not None and last["last"] is not None:
            before = ended.where(F.col("at") < last["last"])
            more = ended.where(F.col("at") == last["last"]).orderBy("job_id").limit(over - before.count())
            state = state.join(before.select("job_id").unionByName(more.select("job_id")), "job_id", "left_anti")
    return state.orderBy(F.desc("created"), F.desc("job_id"))


def ensure_table(spark: SparkSession, name: str, chunks: DataFrame, partition: str = "module") -> None:
    """Creates the table if it isn't there; a second call does nothing."""
    if not spark.catalog.tableExists(name):
        chunks.limit(0).write.partitionBy(partition).saveAsTable(name)


def swap(frame: DataFrame, path: str) -> None:
    """Writes the new rows beside the old, sets the old aside, and deletes them once the new stand in place.

    A failure at any point leaves the old rows or the new at ``path``, or the old at ``path.old`` and the new at
    ``path.new``; nothing is lost.
    """
    spark = frame.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, now, old = hadoop(path + ".new"), hadoop(path), hadoop(path + ".old")
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    frame.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(now):
        fs.delete(old, True)  # what an earlier swap left after it had ended
        if not fs.rename(now, old):
            raise OSError(f"{path}: the new rows stay in {path}.new")
    if not fs.rename(new, now):
        fs.rename(old, now)
        raise OSError(f"{path}: the new rows stay in {path}.new")
    fs.delete(old, True)


def cached(requests: DataFrame, cache: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): only misses need the expensive step."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def cache_uri(sha: Column, folder: str = "ocr-cache") -> Column:
    return F.concat(F.lit(f"{folder}/"), sha, F.lit(".json"))


def image_type(content: Column) -> Column:
    """The file extension of an image by its first bytes; png if unknown (fixed values)."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").otherwise("png")
