"""Documents from text, Parquet, OCR JSON, batch result lines and binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import strip, strip_markup

EXTENSIONS = ("pdf", "docx")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """source, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def ocr_responses(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name), raw: one JSON response a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("raw"))


def result_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (of the line in its file, from 0) and value of the lines of JSONL files that aren't blank.

    Files are read in splits, wherever lines end. A split's lines are numbered within it, and the splits' counts are summed
    over those before it in its file; so no file is read by one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # a reader gives an empty split no rows; the splits of a file are few
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = lines.withColumn("own", own).join(counts, ["file", "block"])
    return numbered.where(F.trim("value") != "").select("file", (F.col("before") + F.col("own")).cast("long").alias("ordinal"), F.rtrim("value").alias("value"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def guarded(files: DataFrame, allowed: Iterable[str] = EXTENSIONS, name: str = "source") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) by file extension."""
    fits = F.coalesce(extension(F.col(name)).isin(*allowed), F.lit(False))
    return files.where(fits), files.where(~fits).withColumn("reason", F.concat(F.lit("unsupported extension: "), extension(F.col(name))))


def error_kind(error: Column) -> Column:
    """What a failed ingestion is reported as."""
    e = F.lower(error)
    return F.when(e.contains("429") | e.contains("quota"), "quota").when(e.contains("timeout") | e.contains("timed out"), "timeout").when(e.contains("api key") | e.contains("401") | e.contains("403"), "credentials").when(e.contains("connect"), "unreachable").otherwise("failed")


def binary_documents(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """source, text, error of every file that an extractor is registered for; a file that fails keeps its error."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("source"), "content")
    files, _ = guarded(files, tuple(extractors))

    def run(frames):
        for pdf in frames:
            rows = []
            for source, content in zip(pdf["source"], pdf["content"], strict=True):
                try:
                    rows.append((source, extractors[source.rpartition(".")[2].lower()](bytes(content)), None))
                except Exception as exc:  # noqa: BLE001 - one bad file must not stop the rest
                    rows.append((source, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["source", "text", "error"])

    return files.mapInPandas(run, "source string, text string, error string")


def html_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, n_headings, text (without scripts, styles and tags) and tables (HTML of each)."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return pages.select(*[c for c in pages.columns if c != html], strip(F.regexp_extract(bare, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("title"), F.regexp_count(bare, F.lit(r"(?i)<h[1-6][ >]")).alias("n_headings"), strip_markup(bare).alias("text"), F.regexp_extract_all(bare, F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1)).alias("tables"))
