"""Typed options from the session's configuration (``spark.lexmill.*``): what operators take where a caller names no value."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Options:
    top_k: int = 5
    most_many: int = 8
    rerank_pool: int = 25
    batch_bytes: int = 16 * 1024 * 1024
    batch_rows: int = 256
    embed_batch: int = 50
    job_cap: int = 200
    model_tries: int = 4

    @classmethod
    def of(cls, spark: SparkSession) -> Options:
        return cls(**{f.name: int(v) for f in fields(cls) if (v := spark.conf.get(f"spark.lexmill.{f.name}", None)) is not None})
