"""Removal of repeated line runs by a suffix array over line ids, built by distributed prefix doubling.

A line is told by two 64-bit hashes of its exact text, a row by the 128 bits of its id and text. Suffixes that start
with a line that occurs once are left out at once: no repeated run holds them. The others are ranked by their first
line, then again and again by twice as many lines: the pair of a suffix's rank and the rank of the suffix as many lines
further on. A rank is a gapped place in the suffix array, the number of suffixes in groups before its own, so two groups
never share one: a group of suffixes that agree so far is a longest-common-prefix interval, spread over its own places
in the order of their second halves. Suffixes leave once nothing else begins with their lines. The groups behind one
common line are counted by parts of the places first, so no task holds all that follows it.

A run of any length that reaches the least words is the union of least windows: those that reach the words from a first
line with as few lines as possible, and those that reach them up to a last line. Every one of them has its own earlier
copy inside the run's source, and every window with an earlier copy is such a run. So each least window is compared with
all positions: a window of L lines is told by L and the ranks, by the largest power of two up to L, of its first and
last so many lines. The rounds end when no least window is longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, let, sized

#: Later copies of runs with at least so many words are removed.
MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
#: Parts of the suffix array's places that what follows one group is counted by.
PARTS = 4_096


def _key() -> Column:
    """128 bits of a row's id and text; null for a null text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.col("text"))))


def _with_place(groups: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``groups`` with before: the sum of n over those ahead of it under the same ``by``, in the order of part, then ``order``.

    Parts are summed first: a window holds the parts of one ``by``, or the groups of one part.
    """
    groups = checkpointed(groups)
    ahead = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = groups.groupBy(*by, "part").agg(F.sum("n").alias("_n"))
    parts = checkpointed(parts.withColumn("_ahead", ahead("_n", Window.partitionBy(*by).orderBy("part"))).drop("_n"))
    own = groups.withColumn("before", ahead("n", Window.partitionBy(*by, "part").orderBy(*order)))
    return own.join(sized(parts), [*by, "part"]).withColumn("before", F.col("before") + F.col("_ahead")).drop("_ahead", "part")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key, copy, start, end, source_doc_id, source_start: the least windows of ``min_words`` (1 at least) words with an earlier copy.

    Their union is that of all runs of so many words, of any length, that occur earlier. ``key`` stands for a row's id
    and text, ``copy`` counts rows that are equal in both (from 0); ``start`` and ``end`` are lines from 0, end excluded.
    Earlier means: smaller doc_id (nulls first), then key, copy and line; the source is the earliest copy.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # rows equal in id and text are one row with a count, so that their copies need no order among the texts
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("id"), F.xxhash64(F.lit(1), x).alias("check"), F.size(F.filter(F.split(x, SPACE), lambda w: w != "")).alias("w")))
    rows = checkpointed(rows.select("doc_id", _key().alias("key"), lines.alias("lines")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("lines").alias("lines"), F.count("*").alias("times")))
    each = rows.select("doc_id", "key", F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int"))).alias("copy"), "lines")
    each = each.select("doc_id", "key", "copy", F.posexplode("lines").alias("line", "x")).select("doc_id", "key", "copy", "line", "x.id", "x.check")

    often = checkpointed(each.groupBy("id", "check").agg(F.count("*").alias("n")).where("n > 1"))
    places = often.agg(F.sum("n")).first()[0] or 0
    often = _with_place(often.withColumn("part", F.shiftright("id", 48)), [], ["id", "check"]).drop("n").withColumnRenamed("before", "rank")
    often = sized(checkpointed(often))
    windows = checkpointed(_least_windows(rows, min_words).join(often, ["id", "check"], "left_semi").drop("id", "check"))
    longest = windows.agg(F.max("size")).first()[0] or 0
    now, size, found = checkpointed(each.join(often, ["id", "check"]).drop("id", "check")), 1, None
    while True:
        copies = _later_copies(now, windows, size)
        found = copies if found is None else found.unionByName(copies)
        if 2 * size > longest:
            return found
        second = now.select("key", "copy", (F.col("line") - size).alias("line"), F.col("rank").alias("second"))
        pairs = checkpointed(now.join(second, ["key", "copy", "line"]))
        # groups, not suffixes, are put in order: a common line's followers are summed before
        groups = pairs.groupBy("rank", "second").agg(F.count("*").alias("n")).withColumn("part", F.expr(f"second div {places // PARTS + 1}"))
        groups = _with_place(groups, ["rank"], ["second"]).withColumn("next", F.col("rank") + F.col("before")).where("n > 1").drop("n", "before")
        now = checkpointed(pairs.join(groups, ["rank", "second"]).select("doc_id", "key", "copy", "line", F.col("next").alias("rank")))
        if now.isEmpty():
            return found
        size *= 2


def _least_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """key, id and check (of one of its lines), line, size: the fewest lines with ``min_words`` words from a line on, and up to a line.

    Words are counted within a document, so its own lines meet and copies of a row have the same windows.
    """
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    each = rows.select("key", F.size("lines").alias("n"), total.alias("total"), F.posexplode("lines").alias("line", "x"))
    each = each.select("key", "n", "total", "line", "x.id", "x.check", F.col("x.w").cast("long").alias("w"))
    own = Window.partitionBy("key")
    each = each.withColumn("to", F.sum("w").over(own.orderBy("line"))).withColumn("from", F.col("to") - F.col("w"))
    # a window ends where the first line stands that has enough words between the window's start and itself
    after = own.orderBy(F.desc("from")).rangeBetween(Window.unboundedPreceding, -min_words)
    end = F.coalesce(F.min("line").over(after), F.when(F.col("total") - F.col("from") >= min_words, F.col("n")))
    # and starts behind the last line that has enough words between itself and the window's end
    until = own.orderBy("to").rangeBetween(Window.unboundedPreceding, -min_words)
    start = F.coalesce(F.max("line").over(until) + 1, F.when(F.col("to") >= min_words, 0))
    each = each.withColumn("end", end).withColumn("start", start).withColumn("skipped", F.coalesce(F.max("to").over(until), F.lit(0)))
    first = F.when(F.col("end").isNotNull(), F.struct("line", (F.col("end") - F.col("line")).alias("size")))
    # one that would be short of words without its last line is among the first kind
    other = (F.col("start") < F.col("line")) & (F.col("from") - F.col("skipped") >= min_words)
    last = F.when(other, F.struct(F.col("start").alias("line"), (F.col("line") + 1 - F.col("start")).alias("size")))
    return each.select("key", "id", "check", F.inline(F.array_compact(F.array(first, last))))


def _later_copies(suffixes: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Of the least windows of ``size`` to 2 ``size`` - 1 lines those that occur earlier; ``suffixes`` are ranked by ``size`` lines."""
    some = windows.where(F.col("size").between(size, 2 * size - 1)).join(suffixes, ["key", "line"])
    some = some.withColumn("tail", F.col("line") + F.col("size") - size)
    tails = suffixes.select("key", "copy", F.col("line").alias("tail"), F.col("rank").alias("second"))
    some = checkpointed(some.join(tails, ["key", "copy", "tail"]))
    groups = some.groupBy("size", "rank", "second").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "copy", "line")).alias("source")).where("n > 1")
    later = some.join(groups, ["size", "rank", "second"]).where(~F.struct("doc_id", "key", "copy", "line").eqNullSafe(F.col("source")))
    return checkpointed(later.select("key", "copy", F.col("line").alias("start"), (F.col("line") + F.col("size")).alias("end"), F.col("source.doc_id").alias("source_doc_id"), F.col("source.line").alias("source_start")))


def without_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs cut from ``text``, and the column removed_lines.

    A text that was a copy from its first line to its last becomes empty. Null texts stay null; empty texts, ties and
    repeated rows are handled like others: of rows equal in id and text the first keeps its lines. Clashing names do
    no harm: ``docs``' other columns pass through in a struct. An empty table gives no rows.
    """
    # overlapping windows are joined to disjoint spans first, so that a text's spans hold each of its lines once at most
    own = Window.partitionBy("key", "copy").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("start") > F.coalesce(before, F.lit(-1)), 1).otherwise(0)
    spans = repeated_runs(docs, min_words).select("key", "copy", "start", "end").distinct().withColumn("begins", begins)
    spans = spans.withColumn("span", F.sum("begins").over(own)).groupBy("key", "copy", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = checkpointed(spans.groupBy("key", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = packed.withColumn("_key", _key()).drop("doc_id")
    twice = sized(checkpointed(runs.where("copy > 0").select(F.col("key").alias("_again")).distinct()))
    if twice.isEmpty():
        packed = packed.withColumn("_copy", F.lit(0))
    else:
        # only rows that repeat are numbered; rows of one number are equal, so any order will do
        single = packed.join(twice, F.col("_key") == F.col("_again"), "left_anti").withColumn("_copy", F.lit(0))
        again = packed.join(twice, F.col("_key") == F.col("_again"), "left_semi")
        packed = single.unionByName(again.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy("_key")) - 1))
    runs = sized(runs)
    out = packed.join(runs, (F.col("_key") == F.col("key")) & (F.col("_copy") == F.col("copy")), "left")
    lines = F.split("text", "\n", -1)
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    left = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = out.withColumn("_text", text)
    removed = F.when(F.col("spans").isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long")
    return out.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in names], removed.alias("removed_lines"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: texts without later copies; documents that were nothing but later copies go.

    Where a text was cut, a column n_chars gets its new length.
    """
    out = without_repeated_runs(docs)
    out = out.where("NOT (removed_lines > 0 AND trim(BOTH ' \t\r\n' FROM text) = '')")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("removed_lines")
