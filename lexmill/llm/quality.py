"""Quality rules by cross-document line frequency. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, let, sized

#: What parts words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate in more than this share of a host's distinct texts. The count only guards against chance in
#: hosts of a few hundred texts: beyond them the share alone decides, whatever the host's size.
LINE_DOCS = 5
LINE_SHARE = 0.01
#: A document is depleted if less than this share of its words is outside boilerplate lines.
LEAST_LEFT = 0.2


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def without_lines(text: Column, hashes: Column) -> Column:
    """``text`` without the lines whose normalised hashes are in ``hashes``; white lines stay."""
    gone = lambda x: x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(hashes, F.xxhash64(normal(x)))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~gone(x)), "\n")


def repeated_words(words: Column) -> Column:
    """Words (places) inside 3-word windows that occur twice or more; ``words`` should be a lambda variable.

    Windows are compared by 64-bit hashes: those of equal hash are neighbours once sorted, and the union of the
    repeated windows' places is summed in their order.
    """

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        places = let(ranked, lambda s: F.sort_array(F.transform(again(s), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, zero, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some).cast("long")


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines: hash and words of each normalised line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = lambda x: let(normal(x), lambda y: F.struct(F.xxhash64(y).alias("h"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("w")))
    by_word = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.transform(x, hashed).alias("lines")))
    return F.struct(by_word.alias("word"), by_line.alias("line"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))


def line_frequency_rules(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row for each row of ``docs`` (row_id, doc_id): the measures, left_words, removed_lines, base_failed and kept.

    Line frequency counts distinct texts of a host (null: a host of its own), so exact copies count once. Lines above
    the limits are removed: removed_lines has their hashes (null: none), for ``without_lines``; a document is kept if the base rules pass and it isn't depleted by the removal. Null and
    empty texts have no words and fail; repeated rows are judged each; an empty table gives no rows; only doc_id,
    text and the host column are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), text.alias("text"))
    one = one.select("row_id", "doc_id", "host", F.xxhash64("text").alias("text_hash"), measures(F.col("text")).alias("m"))
    one = checkpointed(one.select("row_id", "doc_id", "host", "text_hash", "m.word.*", "m.line.*", "m.n_symbols"))
    lines = one.select("row_id", "host", "text_hash", F.inline("lines"))
    often = lines.groupBy("host", "h").agg(F.countDistinct("text_hash").alias("docs")).where(F.col("docs") > line_docs)
    hosts = one.groupBy("host").agg(F.countDistinct("text_hash").alias("host_docs"))
    over = often.join(hosts, often["host"].eqNullSafe(hosts["host"])).where(F.col("docs") > line_share * F.col("host_docs"))
    over = sized(checkpointed(over.select(often["host"].alias("_host"), F.col("h").alias("_h"))))
    removed = lines.join(over, F.col("host").eqNullSafe(F.col("_host")) & (F.col("h") == F.col("_h")))
    removed = removed.groupBy(F.col("row_id").alias("_row")).agg(F.sum("w").cast("long").alias("_words"), F.collect_set("h").alias("removed_lines"))
    out = one.drop("lines").join(removed, F.col("row_id") == F.col("_row"), "left")
    out = out.withColumn("left_words", F.col("n_words") - F.coalesce("_words", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (F.col("left_words") >= least_left * F.col("n_words"))
    return out.select("row_id", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_words", "removed_lines", failed.alias("base_failed"), kept.alias("kept"))


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns, and their texts without lines above the limits.

    Where lines went, a column n_chars gets the text's new length. The rejected rows' keys are anti-joined, the removed
    lines' hashes joined: broadcast when counted few, else by a shuffle.
    """
    key = {"_id": F.col("doc_id"), "_host": F.col("host"), "_hash": F.col("text_hash")}
    verdict = checkpointed(line_frequency_rules(docs, **limits).select(*[c.alias(k) for k, c in key.items()], "kept", "removed_lines"))
    gone = sized(checkpointed(verdict.where(~F.col("kept")).select(*key).distinct()))
    cut = verdict.where("kept AND removed_lines IS NOT NULL").select(*key, F.col("removed_lines").alias("_cut")).dropDuplicates(list(key))
    cut = sized(checkpointed(cut))
    # a row's columns travel in a struct, so their names can't clash with the keys'
    text, host = F.col("text").cast("string"), F.col(f"`{limits.get('host', 'source')}`").cast("string")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_mine"), host.alias("_at"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_said"))
    mine = F.col("_mine").eqNullSafe(F.col("_id")) & F.col("_at").eqNullSafe(F.col("_host")) & (F.col("_said") == F.col("_hash"))
    out = out.join(gone, mine, "left_anti").join(cut, mine, "left")
    some, text = F.col("_cut").isNotNull(), F.col("_doc.text").cast("string")
    new = {"text": F.when(some, without_lines(text, F.col("_cut"))).otherwise(F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length(without_lines(text, F.col("_cut"))).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return out.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS ws FROM d),
tri AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM tri),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY r),
raw AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, source, t, line, trim(regexp_replace(lower(line), '{SPACE}', ' ', 'g'), ' ') AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
host AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
often AS (SELECT l.source, norm FROM l JOIN host h ON l.source IS NOT DISTINCT FROM h.source
          GROUP BY l.source, norm, h.n HAVING count(DISTINCT t) > {LINE_DOCS} AND count(DISTINCT t) > {LINE_SHARE} * h.n),
gone AS (SELECT r, sum(len(string_split(l.norm, ' '))) AS n FROM l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(gone.n, 0))::BIGINT AS left_words
      FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND left_words >= {LEAST_LEFT} * n_words AS kept FROM f
"""
