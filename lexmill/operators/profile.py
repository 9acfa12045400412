"""Document profiles: page samples, metrics, verdicts, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators import ranks


def sample_pages(n: Column, k: int = 18) -> Column:
    """First three, last three and an even stride between; all if there are no more than ``k``. Pages from 0."""
    stride = F.greatest(F.lit(1), F.floor((n - 6) / (k - 6)).cast("int"))
    middle = F.slice(F.sequence(F.lit(3), n - 4, stride), 1, k - 6)
    some = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(1), F.lit(2)), middle, F.array(n - 3, n - 2, n - 1))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= k, F.sequence(F.lit(0), n - 1)).otherwise(some)


def thumbnail_pages(n: Column, count: int = 5) -> Column:
    picks = [F.lit(0), F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int"), F.floor(3 * n / 4).cast("int"), n - 1]
    return F.when(n > 0, F.slice(F.array_sort(F.array_distinct(F.array(*picks))), 1, count)).otherwise(F.array().cast("array<int>"))


def line_ratio(text: Column, pattern: str) -> Column:
    """Share of the non-blank lines that the pattern is found in; 0 without lines."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.rlike(pattern))) / F.size(lines)).otherwise(0.0)


# Dot leaders, index entries, control characters, words.
LEADER = r"\.{4,}\s*\d+\s*$"
INDEXY = r"(?U)^[A-Za-z][\w\s\-,'()]{2,60},\s*\d+(\s*[,–-]\s*\d+)*\s*$"
GARBAGE = r"[\x{FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]"
WORD = r"[A-Za-zÀ-ɏ]{3,}"


def page_measures(pages: DataFrame) -> DataFrame:
    """doc_id, page, text (, image_ratio, has_fonts) to one row of counts a page."""
    t = F.coalesce("text", F.lit(""))
    return pages.select("doc_id", "page", F.length(strip(t)).alias("chars"), F.length(t).alias("raw"), (F.length(t) - F.length(F.regexp_replace(t, GARBAGE, ""))).alias("garbage"), F.regexp_count(t, F.lit(WORD)).alias("words"), (F.least(F.col("image_ratio"), F.lit(1.0)) if "image_ratio" in pages.columns else F.lit(0.0)).alias("image_ratio"), (F.col("has_fonts") if "has_fonts" in pages.columns else F.lit(True)).alias("has_fonts"))


def metrics(measures: DataFrame) -> DataFrame:
    """One row a document. p90 is the nearest rank below: sorted[max(0, int(0.9 n) - 1)].

    Documents may have any number of pages (``sampled`` takes some): medians and p90 are found by rank, not by gathering.
    """
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    sums = measures.groupBy("doc_id").agg(
        F.count("*").alias("pages"),
        F.avg((F.col("chars") < 20).cast("double")).alias("no_text"),
        ratio("garbage", "raw").alias("garbage_ratio"),
        (5 * ratio("words", "raw")).alias("word_like"),
        F.bool_or("has_fonts").alias("has_fonts"),
    )
    n = F.col("n")
    middle = {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1}
    chars = ranks.values_at(measures, "doc_id", "chars", middle | {"p90": F.greatest(F.lit(1), F.floor(n * 0.9))})
    images = ranks.values_at(measures, "doc_id", "image_ratio", middle)
    half = (F.col("low") + F.col("high")) / 2
    chars = chars.select(F.col("doc_id").alias("_c"), half.alias("chars_median"), F.col("p90").cast("int").alias("chars_p90"))
    images = images.select(F.col("doc_id").alias("_i"), half.alias("image_median"))
    same = lambda c: F.col("doc_id").eqNullSafe(F.col(c))
    return sums.join(chars, same("_c")).join(images, same("_i")).select("doc_id", "pages", "chars_median", "chars_p90", "image_median", "no_text", "garbage_ratio", "word_like", "has_fonts")


def sampled(pages: DataFrame, k: int = 18) -> DataFrame:
    """The pages (doc_id, page from 0) of each document that ``sample_pages`` takes: all of a short one, ``k`` of a long one."""
    n = pages.groupBy("doc_id").agg((F.max("page") + 1).cast("int").alias("_n")).withColumnRenamed("doc_id", "_doc")
    picks = n.select("_doc", F.explode(sample_pages(F.col("_n"), k)).alias("_page"))
    return pages.join(picks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("page") == F.col("_page")), "left_semi")


def verdict() -> tuple[Column, Column]:
    """(verdict, confidence) of a metrics row: ordered rules, the first that holds."""
    median, image = F.col("chars_median"), F.col("image_median")
    rules = (
        ((median < 40) & (image > 0.55), "scanned", 0.95),
        (median < 40, "scanned", 0.80),
        ((F.col("garbage_ratio") > 0.02) | ((F.col("word_like") < 0.45) & (median > 200)), "scanned", 0.70),
        (F.col("no_text") > 0.30, "mixed", 0.60),
        ((median > 400) & (image < 0.40), "native", 0.92),
    )
    name = score = None
    for test, v, c in rules:
        name = F.when(test, v) if name is None else name.when(test, v)
        score = F.when(test, c) if score is None else score.when(test, c)
    return name.otherwise("unknown"), score.otherwise(0.40)


def guess_contents(pages: DataFrame, head: int = 60, tail: int = 90) -> DataFrame:
    """doc_id with the pages that look like a table of contents and like an index."""
    last = F.max("page").over(Window.partitionBy("doc_id"))
    marked = pages.withColumn("_n", last + 1).select("doc_id", "page", ((F.col("page") < head) & (line_ratio(F.col("text"), LEADER) > 0.30)).alias("toc"), ((F.col("page") >= F.col("_n") - tail) & (line_ratio(F.col("text"), INDEXY) > 0.40)).alias("idx"))
    return marked.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("toc"), F.col("page")))).alias("toc_pages"), F.sort_array(F.collect_list(F.when(F.col("idx"), F.col("page")))).alias("index_pages"))


def page_spec(start: Column, end: Column, skip: Column) -> Column:
    """Pages to process: an inclusive range without the skipped; null for a whole document; an open end adds 5000."""
    lo = F.coalesce(start, F.lit(0))
    hi = F.coalesce(end, lo + 5000)
    pages = F.when(hi >= lo, F.sequence(lo, F.greatest(hi, lo))).otherwise(F.array().cast("array<int>"))
    return F.when(start.isNull() & end.isNull() & (F.coalesce(F.size(skip), F.lit(0)) <= 0), F.lit(None).cast("array<int>")).otherwise(F.filter(pages, lambda p: ~F.array_contains(F.coalesce(skip, F.array().cast("array<int>")), p)))


