"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: N-grams in a profile, of a language and of a document.
PROFILE = 400
ORDERS = 3
#: Characters per counting step; a longer text is counted in several steps and summed.
STEP = 1 << 20
FOLDS, HELD_OUT = 3, 1


class _Alphabet:
    """Code points as small numbers: 1 what isn't a letter, else a letter's lower-case code point (below 2^21)."""

    def __init__(self):
        # all planes: letters stand beyond U+30000, too
        self.to = np.ones(0x110000, "u4")
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                self.to[c] = ord(low) if len(low) == 1 else c


_EDGE = np.ones(1, "u8")
_EDGES = np.uint64(1 | 1 << 21)
_alphabet: list[_Alphabet] = []


def alphabet() -> _Alphabet:
    if not _alphabet:
        _alphabet.append(_Alphabet())
    return _alphabet[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts) of one to three letters; words are bounded by 1, and runs of other characters count once.

    An n-gram is a number of 63 bits, 21 for each code point, its first character lowest.
    """
    codes, counts = [], []
    for at in range(0, len(text), STEP):
        # steps overlap by two characters, so that every n-gram is counted where it ends
        lead = min(2, at)
        x = alphabet().to[np.frombuffer(text[at - lead : at + STEP].encode("utf-32-le", "replace"), "<u4")].astype("u8")
        if not at:
            x = np.concatenate([_EDGE, x])
            lead = 1
        if at + STEP >= len(text):
            x = np.concatenate([x, _EDGE])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 1) | (x[:-1] != 1)
        first = int(keep[:lead].sum())
        x = x[keep]
        one = x[first:]
        one = one[one != 1]
        two = x[:-1] | (x[1:] << np.uint64(21))
        three = two[:-1] | (x[2:] << np.uint64(42))
        two, three = two[max(0, first - 1) :], three[max(0, first - 2) :]
        # an n-gram of boundaries only, or one whose middle is a boundary, says nothing of a word
        three = three[(three >> np.uint64(21)) & np.uint64(0x1FFFFF) != 1]
        u, n = np.unique(np.concatenate([one, two[two != _EDGES], three]), return_counts=True)
        codes.append(u)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    if not codes:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    u, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts)).astype("i8")


def most_frequent(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams by rank; ties to the smaller code."""
    if len(codes) > size:  # what can't be among them goes first, ties of the last place stay
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


def profiles(train: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams over all texts of ``train`` (text, lang); only profiles reach the driver.

    Every task sums its own counts before they are shuffled; languages with more rows just sum more. Null texts and
    null languages teach nothing.
    """

    def count(batches):
        total: dict[str, list] = defaultdict(list)

        def flush():
            for lang, parts in total.items():
                u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield lang, u, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype("i8")
            total.clear()

        held = 0
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                part = grams(text.as_py())
                total[lang].append(part)
                held += len(part[0])
                if held > 1_000_000:
                    small = list(flush())
                    held = sum(len(u) for _, u, _ in small)
                    for lang_, u, n in small:
                        total[lang_].append((u, n))
                    if held > 500_000:
                        for lang_, u, n in flush():
                            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(u)), pa.array(u.astype("i8")), pa.array(n)], names=["lang", "code", "n"])
                        held = 0
        for lang, u, n in flush():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype("i8")), pa.array(n)], names=["lang", "code", "n"])

    counted = train.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, code long, n long")
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = total.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "code", "rank").collect()
    out: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out[r["lang"]].append(r["code"])
    return {lang: np.array(codes, "i8").view("u8") for lang, codes in out.items()}


class Judge:
    """Out-of-place distances of a document's profile to each language's."""

    def __init__(self, learned: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(learned), size
        codes = np.unique(np.concatenate([learned[k] for k in self.langs])) if self.langs else np.zeros(0, "u8")
        #: rank of each known n-gram in each language; beyond the profile: the profile's size
        self.codes, self.ranks = codes, np.full((len(codes), len(self.langs)), size, "i4")
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(codes, learned[lang]), k] = np.arange(len(learned[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        codes, counts = grams(text)
        own = most_frequent(codes, counts, self.size)
        if not len(own):
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        ranks = np.where(known[:, None], self.ranks[at], self.size)
        away = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: one less the share of the largest distance).

    'und' if the text is null or has no letter, or nothing was learned. Ties go to the first language by name.
    """

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        one = Judge(learned, size)
        return pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    out = docs.withColumn("_judged", judge(F.col("text").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_judged.lang_pred", "_judged.score")


def held_out():
    """Whether a document is kept from learning: its id's CRC modulo 3 is 1 (null id: the empty string's, 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def rank_order_language(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; profiles are learned from the rows that aren't held out.

    Repeated rows count and are judged each; an empty table gives no rows; very long texts are counted in steps of
    2^20 characters; further columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out().alias("held_out"))
    learned = profiles(rows.where(~F.col("held_out")).select("text", "lang"), size)
    return identify(rows.select("doc_id", "held_out", "text"), learned, size).drop("text")


#: In the pipeline a document is rejected below this score.
LEAST_SCORE = 0.1


def identified_documents(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is known well enough, with their columns; learned from ``docs`` itself."""
    learned = profiles(docs.where(~held_out()).select("text", "lang"))
    judged = identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text"), learned)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_doc.*")
