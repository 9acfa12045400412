"""A chunk table whose every change is one new snapshot.

Rows lie in buckets of their source (in lower case, so that all spellings of a source share one), a bucket in folders that are
never changed. A snapshot is a small file that lists the folders of each bucket; the table is what the snapshot with the
greatest number lists. A change writes the touched buckets anew beside the old, then puts the next snapshot in place by one
rename that fails if another change was first. So a reader always finds a whole table, old or new, and a change that is cut
short leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import case_variants
from lexmill.operators.retrieval import metadata_filter

#: Buckets of a new table: a snapshot has as many entries at most.
BUCKETS = 256


class ConcurrentChange(Exception):
    """Another change came first; the table is whole, and the change may be tried again."""


class ChunkTable:
    """A table at ``path``, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._place(self.path).getFileSystem(self._conf)

    def _place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        log = self._place(f"{self.path}/_snapshots")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def snapshot(self, version: int | None = None) -> dict:
        """version, schema, key, buckets, and the folders of each bucket, of a snapshot (the last by default)."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        if version not in known:
            raise LookupError(f"{self.path}: no snapshot {version}" if known else f"{self.path} is no table")
        stream = self._fs.open(self._place(f"{self.path}/_snapshots/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, schema: T.StructType, key: str = "source", buckets: int = BUCKETS) -> None:
        """An empty table, if there is none; a second call does nothing."""
        if not self.exists():
            try:
                self._commit({"version": 0, "schema": json.loads(schema.json()), "key": key, "buckets": buckets, "folders": {}})
            except ConcurrentChange:
                pass  # someone else made it

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a snapshot, the last by default."""
        return self._rows(self.snapshot(version), None)

    def _rows(self, snapshot: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(snapshot["schema"])
        folders = [f"{self.path}/{f}" for b, fs in snapshot["folders"].items() if buckets is None or int(b) in buckets for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, snapshot: dict, source: Column) -> Column:
        return F.pmod(F.xxhash64(F.lower(F.coalesce(source, F.lit("")))), F.lit(snapshot["buckets"])).cast("int")

    def _commit(self, snapshot: dict) -> None:
        log, name = f"{self.path}/_snapshots", f"{snapshot['version']:012d}.json"
        beside = self._place(f"{log}/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(json.dumps(snapshot).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        strictly = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(beside, self._place(f"{log}/{name}"), strictly)
        except Exception as error:
            self._fs.delete(beside, False)
            if self._fs.exists(self._place(f"{log}/{name}")):
                raise ConcurrentChange(f"{self.path}: snapshot {snapshot['version']} is another's") from error
            raise

    def _rewrite(self, snapshot: dict, touched: list[int], rows: DataFrame, **noted: object) -> None:
        """The next snapshot: ``rows`` in place of all rows of the ``touched`` buckets, and what is ``noted``."""
        folders = {b: fs for b, fs in snapshot["folders"].items() if int(b) not in touched}
        if touched:
            data = f"data/{uuid.uuid4().hex}"
            schema = T.StructType.fromJson(snapshot["schema"])
            out = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema], self._bucket(snapshot, F.col(f"`{snapshot['key']}`")).alias("_bucket"))
            out.write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
            for status in self._fs.listStatus(self._place(f"{self.path}/{data}")):
                name = status.getPath().getName()
                if name.startswith("_bucket="):
                    folders[name.removeprefix("_bucket=")] = [f"{data}/{name}"]
        self._commit(snapshot | noted | {"version": snapshot["version"] + 1, "folders": folders})

    def _touched(self, snapshot: dict, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``: no more than the table has."""
        return [r[0] for r in rows.select(self._bucket(snapshot, F.col(f"`{snapshot['key']}`"))).distinct().collect()]

    def replace_sources(self, fresh: DataFrame) -> tuple[int, int]:
        """(removed, added): rows of the sources that ``fresh`` brings, in any spelling, give way to it; other sources stay.

        Columns that ``fresh`` lacks are null. Nothing of the old rows goes before the new ones are written.
        """
        now = self.snapshot()
        key = now["key"]
        touched = self._touched(now, fresh)
        old = self._rows(now, touched)
        new = fresh.select(F.explode(case_variants(F.col(f"`{key}`"))).alias("_key")).distinct()
        gone = old.join(new, F.col(f"`{key}`") == F.col("_key"), "left_semi").count()
        stays = old.join(new, F.col(f"`{key}`") == F.col("_key"), "left_anti")
        names = set(fresh.columns)
        full = fresh.select(*[F.col(f"`{f.name}`") if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromJson(now["schema"])])
        added = full.count()
        self._rewrite(now, touched, stays.unionByName(full))
        return gone, added

    def replace_rows(self, keys: DataFrame, fresh: DataFrame, **noted: object) -> None:
        """Rows that agree with a row of ``keys`` (the table's key among its columns; nulls agree) give way to ``fresh``, in one snapshot.

        What is ``noted`` stands in the snapshot, so that a caller can tell whether a change was made before.
        """
        now = self.snapshot()
        touched = self._touched(now, keys.select(now["key"]).unionByName(fresh.select(now["key"])))
        gone = keys.toDF(*[f"_{c}" for c in keys.columns]).distinct()
        agrees = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`")) for c in keys.columns]
        test = agrees[0]
        for more in agrees[1:]:
            test = test & more
        stays = self._rows(now, touched).join(gone, test, "left_anti")
        self._rewrite(now, touched, stays.unionByName(fresh.select(*stays.columns)), **noted)

    def delete(self, meta: Mapping[str, object]) -> int:
        """Deletes the rows that match ``meta`` and returns their number; with no condition nothing is deleted."""
        test = metadata_filter(meta)
        if test is None:
            return 0
        now = self.snapshot()
        test = F.coalesce(test, F.lit(False))
        matching = self._rows(now, self._buckets_of(now, meta)).where(test)
        touched = self._touched(now, matching)
        n = matching.count() if touched else 0
        if n:
            self._rewrite(now, touched, self._rows(now, touched).where(~test))
        return n

    def retag(self, source: str, url: str, column: str = "file_url") -> int:
        """Sets one column of a source's rows, in any spelling, and returns their number."""
        test = metadata_filter({"source": source})
        if test is None:
            return 0
        now = self.snapshot()
        test = F.coalesce(test, F.lit(False))
        touched = self._buckets_of(now, {"source": source})
        rows = self._rows(now, touched)
        n = rows.where(test).count()
        if n:
            self._rewrite(now, touched, rows.withColumn(column, F.when(test, F.lit(url)).otherwise(F.col(f"`{column}`"))))
        return n

    def _buckets_of(self, snapshot: dict, meta: Mapping[str, object]) -> list[int] | None:
        """The one bucket in which a named source can lie; all without one."""
        source = meta.get("source") if snapshot["key"] == "source" else None
        if not isinstance(source, str) or not source:
            return None
        return [self.spark.range(1).select(self._bucket(snapshot, F.lit(source))).first()[0]]

    def vacuum(self, keep: int = 2) -> int:
        """Deletes snapshots but the last ``keep`` and the folders that none of those lists; returns the folders' number."""
        known = self.versions()
        for version in known[:-keep]:
            self._fs.delete(self._place(f"{self.path}/_snapshots/{version:012d}.json"), False)
        used = {f for v in known[-keep:] for fs in self.snapshot(v)["folders"].values() for f in fs}
        n, data = 0, self._place(f"{self.path}/data")
        for change in self._fs.listStatus(data) if self._fs.exists(data) else ():
            whole = True
            for folder in self._fs.listStatus(change.getPath()):
                name = f"data/{change.getPath().getName()}/{folder.getPath().getName()}"
                if folder.getPath().getName().startswith("_bucket=") and name in used:
                    whole = False
                elif folder.isDirectory():
                    self._fs.delete(folder.getPath(), True)
                    n += 1
            if whole:
                self._fs.delete(change.getPath(), True)
        return n
