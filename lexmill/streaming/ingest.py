"""Structured Streaming: documents into the chunk table batch by batch; case context kept per conversation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexmill.operators.chunking import chunk_documents
from lexmill.operators.snapshots import ChunkTable


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet documents (doc_id, source, text, ..) from a folder to a chunk table (``snapshots.ChunkTable``) at ``target``.

    A batch replaces the chunks of its own documents; a source's other documents keep theirs, so a source may arrive in
    several batches. Each batch is one snapshot that notes its number, so a repeated batch changes nothing, and one that is
    cut short leaves the table as it was. Of a document that comes twice in a batch the one of the newest file counts (ties:
    the greater file name, then text).
    """
    stream = spark.readStream.schema(schema).parquet(source)
    stream = stream.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name").alias("_file"))

    def write(batch: DataFrame, number: int) -> None:
        newest = F.max_by("text", F.struct("_file", "text"))
        last = batch.groupBy("doc_id", "source").agg(newest.alias("text"))
        out = chunk_documents(last)
        table = ChunkTable(spark, target)
        table.create(out.schema)
        done = table.snapshot().get("batches", {})
        if done.get(checkpoint, -1) < number:
            table.replace_rows(last.select("doc_id", "source"), out, batches=done | {checkpoint: number})

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_header = re.compile(r"\s*(cas\s+clinique|observation\s+clinique|cas\s+n[°o]|(?:une?\s+)?patient[e]?\b)", re.IGNORECASE)
_number = re.compile(r"^\s*(\d{1,2})\s*[.)]\s", re.MULTILINE)


def remember(message: str, memory: str) -> tuple[bool, str]:
    """(is new, context): a header or an empty memory begins a case; a first question beyond 1 goes on with it; what is
    in doubt goes on too (a model decides where there is one)."""
    first = _number.search(message)
    lead = message[: first.start()].strip() if first and first.start() else ""
    new = bool(_header.match(message)) or not memory
    return new, lead if new else f"{memory}\n\n{lead}".strip() if lead else memory


class CaseMemory(StatefulProcessor):
    """A conversation's state is the context of its case so far; it is forgotten when nothing was added for ``ttl_ms``."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "memory string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        memory = self.memory.get()[0] if self.memory.exists() else ""
        # a conversation's turns of one batch, in order
        batch = pd.concat(list(rows)).sort_values(["turn", "text"], na_position="first", kind="stable")
        out = []
        for turn, text in zip(batch["turn"].tolist(), batch["text"].tolist(), strict=True):
            new, memory = remember(text if isinstance(text, str) else "", memory)
            out.append((key[0], turn, new, memory))
        self.memory.update((memory,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "is_new", "context"])

    def close(self) -> None:
        pass


def case_memory(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """conv_id, turn, is_new, context of a stream of (conv_id, turn, text): each message with the case it belongs to.

    Turns of a conversation must come in order from batch to batch; within one they are sorted. The session's state store
    must be RocksDB (``case_stream`` sees to it).
    """
    return messages.groupBy("conv_id").transformWithStateInPandas(CaseMemory(ttl_ms), "conv_id long, turn long, is_new boolean, context string", "Append", "ProcessingTime" if ttl_ms else "None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE, NO_DATA = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


def case_stream(spark: SparkSession, source: str, target: str, checkpoint: str, ttl_ms: int | None = None, files: int = 16, once: bool = True) -> StreamingQuery:
    """Parquet messages (conv_id, turn, text) from a folder to their cases, ``files`` files a batch, oldest first.

    The checkpoint holds which files were read and every conversation's state, so a query that is started again goes on
    where the last one ended, and a batch that is repeated writes its rows once.
    """
    messages = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", files).parquet(source)
    # with a time to live every trigger would have a batch of its own, and a run to the end of the files none
    needed = {STORE: ROCKSDB} | ({NO_DATA: "false"} if ttl_ms and once else {})
    before = {name: spark.conf.get(name, None) for name in needed}
    try:
        for name, value in needed.items():
            spark.conf.set(name, value)
        writer = case_memory(messages, ttl_ms).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start(target)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
