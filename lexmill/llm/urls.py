"""URL filter: host and path rules, and beyond them the likelihood ratio of two character language models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BROADCAST_BYTES, checkpointed, sized

# Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Longest context of the models, in bytes.
ORDER = 4
#: One of so many addresses that rules decide is kept from the models, to calibrate the threshold and measure the error.
FOLDS = 5
#: Stands before a text; no byte of UTF-8 text.
_BEFORE = 0xFF
#: Log ratios are summed in these fixed steps, so that sums don't depend on the order.
_STEPS = 1 << 40
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule = verdict = None
    for says, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def address(host: Column, path: Column, url: Column) -> Column:
    """What the models read: host and path (else the url), every run of digits as one 0."""
    return F.regexp_replace(F.when(host != "", F.concat(host, path)).otherwise(F.coalesce(url, F.lit(""))), "[0-9]+", "0")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each order and all bytes of all texts the exact key (order, context, byte) in one number; and the texts' lengths.

    The order stands above 40 bits, below it the context's bytes and the byte: a key without its last 8 bits is the
    context's. A text ends with a 0 byte.
    """
    raw = [t.encode("utf-8", "replace") + b"\0" for t in texts]
    lengths = np.array([len(r) for r in raw], "i8")
    x = np.frombuffer(b"".join(raw), "u1").astype("i8")
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out, gram = np.zeros((ORDER + 1, len(x)), "i8"), x
    for k in range(ORDER + 1):
        if k:
            gram = gram | np.where(place >= k, np.roll(x, k), _BEFORE) << 8 * k
        out[k] = (k << 40) | gram
    return out, lengths


def _counts(addresses: DataFrame) -> DataFrame:
    """gram, allow, block of every n-gram of ``addresses`` (address, allow, block); tasks sum their own before the shuffle."""

    def count(frames):
        for pdf in frames:
            if len(pdf):
                grams, lengths = _grams(pdf["address"].tolist())
                keys, places = np.unique(grams.ravel(), return_inverse=True)
                weigh = lambda c: np.bincount(places.ravel(), np.tile(np.repeat(pdf[c].to_numpy(), lengths), ORDER + 1), len(keys)).astype("i8")
                yield pd.DataFrame({"gram": keys, "allow": weigh("allow"), "block": weigh("block")})

    seen = addresses.select("address", "allow", "block").mapInPandas(count, "gram long, allow long, block long")
    return seen.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def gram_ratios(addresses: DataFrame) -> DataFrame:
    """gram, steps: the log-likelihood ratio, accepted over rejected, of every longest n-gram that occurs in ``addresses``.

    Witten-Bell interpolated models of variable order: a context that was never seen leaves the shorter one's answer.
    Counts are exact; the tables grow with the n-grams seen, and joins are broadcast only while those are counted few.
    """
    grams = checkpointed(_counts(addresses))
    near = F.broadcast if grams.count() * 64 <= BROADCAST_BYTES else lambda df: df
    context = F.shiftright("gram", 8).alias("context")
    # a context has at most one row for each byte
    totals = grams.groupBy(context).agg(*[f(c).alias(n + c) for c in ("allow", "block") for f, n in ((F.sum, "total_"), (lambda c: F.count_if(F.col(c) > 0), "kinds_"))])
    known = checkpointed(grams.withColumn("context", F.shiftright("gram", 8)).join(near(totals), "context").drop("context"))

    def level(k: int) -> DataFrame:
        return known.where(F.shiftright("gram", 40) == k)

    def answer(c: str, shorter) -> Column:
        n, kinds = F.col(f"total_{c}"), F.col(f"kinds_{c}")
        return F.when(n > 0, (F.col(c) + kinds * shorter) / (n + kinds)).otherwise(shorter).alias(f"p_{c}")

    now = level(0).select("gram", *[answer(c, F.lit(1 / 256)) for c in ("allow", "block")])
    for k in range(1, ORDER + 1):
        shorter = F.col("gram").bitwiseAND((1 << 8 * k) - 1).bitwiseOR((k - 1) << 40)
        now = level(k).withColumn("shorter", shorter).join(near(now.withColumnRenamed("gram", "shorter")), "shorter")
        now = now.select("gram", *[answer(c, F.col(f"p_{c}")) for c in ("allow", "block")])
    ratio = F.log(F.greatest("p_allow", F.lit(1e-12))) - F.log(F.greatest("p_block", F.lit(1e-12)))
    return checkpointed(now.select("gram", F.round(ratio * _STEPS).cast("long").alias("steps")))


def _ratios(addresses: DataFrame) -> DataFrame:
    """address, held, ratio: the mean log-likelihood ratio of a byte of each of the distinct ``addresses``; held ones teach nothing."""

    def places(frames):
        for pdf in frames:
            if len(pdf):
                grams, lengths = _grams(pdf["address"].tolist())
                own = pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), lengths), "gram": grams[ORDER]})
                yield own.groupby(["id", "gram"], sort=False).size().reset_index(name="n")

    own = addresses.select("id", "address").mapInPandas(places, "id long, gram long, n long")
    taught = addresses.select("id", "address", *[F.when(F.col("held"), 0).otherwise(F.col(c)).alias(c) for c in ("allow", "block")])
    sums = own.join(sized(gram_ratios(taught)), "gram").groupBy("id").agg((F.sum(F.col("n") * F.col("steps")) / F.sum("n") / _STEPS).alias("ratio"))
    return addresses.join(sums, "id").select("address", "held", "ratio")


def url_filter(pages: DataFrame, rules=RULES, folds: int = FOLDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score, held_out of every row.

    The models learn from the urls that a rule decides, but for one in ``folds`` addresses (by hash; equal addresses go
    together). These calibrate: the threshold stands as many of their standard deviations below the accepted ones' mean
    as above the rejected ones'. score: the mean log-likelihood ratio of a byte, less the threshold; urls without a rule
    are allowed from 0 on. held_out: decided by a rule and not learned from, so the share of these rows whose score
    speaks against their verdict is the method's error. Where either part lacks accepted or rejected urls, all are
    learned from, none is held out and the threshold is 0; with no accepted or no rejected url at all, the rest are
    allowed with score 0. Null urls, and urls without '://', have an empty host and path and no rule; repeated rows are
    judged each; an empty table gives no rows; html and further columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), address(F.col("host"), F.col("path"), F.col("url")).alias("address"))
    rows = checkpointed(rows)
    ruled = [F.count_if(F.col("ruled") == c).alias(c) for c in ("allow", "block")]
    held = F.pmod(F.xxhash64("address"), F.lit(folds)) == 0
    addresses = checkpointed(checkpointed(rows.groupBy("address").agg(*ruled)).withColumn("id", F.monotonically_increasing_id()).withColumn("held", held))
    parts = addresses.groupBy("held").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect()
    calibrated = len(parts) == 2 and all(r["allow"] and r["block"] for r in parts)
    learned = all(sum(r[c] for r in parts) for c in ("allow", "block"))
    if not calibrated:
        addresses = addresses.withColumn("held", F.lit(False))
    scored = rows.join(sized(checkpointed(_ratios(addresses))), "address")
    threshold = 0.0
    if calibrated:
        fit = {r["ruled"]: r for r in scored.where("held AND ruled IS NOT NULL").groupBy("ruled").agg(F.avg("ratio").alias("m"), F.stddev_pop("ratio").alias("s")).collect()}
        a, b = fit["allow"], fit["block"]
        spread = a["s"] + b["s"]
        threshold = (a["m"] * b["s"] + b["m"] * a["s"]) / spread if spread else (a["m"] + b["m"]) / 2
    score = F.col("ratio") - F.lit(threshold) if learned else F.lit(0.0)
    says = F.coalesce("ruled", F.when(score >= 0, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", says.alias("verdict"), score.alias("score"), (F.col("held") & F.col("ruled").isNotNull()).alias("held_out"))
