"""Removal of repeated word passages by sharded Aho-Corasick automata.

A window is a fixed number of consecutive words of one document. Each window chooses one anchor in it: the run of ``SEED``
words of least hash, the first of equals. Windows of the same words choose the same anchor, so a window that stands twice has
an anchor that stands twice, and one or two words in 14 are anchors. Only stretches (an anchor's windows in a row) whose anchor
recurs go on. Stretches of equal words are one kind with a count.

Kinds are dealt to shards by their anchor, so all places of a window meet in one shard. A shard confirms, word by word, which of
its windows recur, joins them to passages, compiles these into automata of a bounded size over blocks of words, and lets
every kind's words run through them. What they find is put back to the places of each kind, and words under a found window
go. A shard with very many kinds (the edges of a passage that very many documents share) is dealt out in parts, whose counts
are summed and which all get its passages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, let, sized, spread, written

#: Words of a window; words of an anchor.
WINDOW, SEED = 35, 8
SPACE = r"[\x20\x09-\x0D]+"
#: Kinds of a shard on average, and of one of its parts; windows of an automaton.
SHARD_KINDS, PART_KINDS, AUTOMATON_WINDOWS = 1_500, 6_000, 20_000
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that they have inverses modulo 2^64


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space only


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses."""
    out = []
    for base in _BASES:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n + 1, b, "u8")
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        out.append(tuple(both))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(words: np.ndarray, window: int, seed: int, powers: list) -> tuple[np.ndarray, ...]:
    """anchor, start, windows, h1, h2 of each stretch of a document told by its words' hashes, ``window`` of them at least."""
    sums = [np.concatenate([np.zeros(1, "u8"), np.cumsum(words * p[: len(words)], dtype="u8")]) for p, _ in powers]
    n = len(words) - seed + 1
    grams = _mixed((sums[0][seed:] - sums[0][:n]) * powers[0][1][:n])
    # the least gram of each window: places of equal hashes count from the left
    low, length = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype="u8"), 1
    across = window - seed + 1
    while 2 * length <= across:
        low, length = np.minimum(low[:-length], low[length:]), 2 * length
    if length < across:
        low = np.minimum(low[: len(low) - (across - length)], low[across - length :])
    at = (low & np.uint64(0xFFFFFFFF)).astype("i8")
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    many = np.diff(np.r_[start, len(at)])
    end = start + many + window - 1
    hashes = [_mixed((s[end] - s[start]) * back[start]) for s, (_, back) in zip(sums, powers, strict=True)]
    return grams[at[start]].view("i8"), start.astype("i4"), many.astype("i4"), *(h.view("i8") for h in hashes)


def _anchored(window: int, seed: int):
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hash_of, powers = xxhash.xxh3_64_intdigest, _powers(1 << 15)
        for pdf in frames:
            out = []
            for k1, k2, text in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["text"].tolist(), strict=True):
                words = _words(text)
                if len(words) < window:
                    continue
                hashes = np.fromiter(map(hash_of, words), "u8", len(words))
                found = stretches(hashes, window, seed, powers if len(words) < 1 << 15 else _powers(len(words)))
                out.append((np.full(len(found[0]), k1), np.full(len(found[0]), k2), *found))
                if len(out) == 256:
                    yield _frame(out)
                    out = []
            if out:
                yield _frame(out)

    return each


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("k1", "k2", "anchor", "start", "windows", "h1", "h2"), zip(*parts, strict=True), strict=True)})


class Letters(dict):
    """One character for each word, in order of appearance."""

    def __missing__(self, word: str) -> str:
        n = len(self) + 1
        self[word] = chr(n if n < 0xD800 else n + 0x800)
        return self[word]


def confirm(kinds: pd.DataFrame, window: int) -> Iterator[tuple[str, int]]:
    """(passage, places) of recurring windows, joined where they follow on each other; in a part of a split shard, each window by itself."""
    letters, counts = Letters(), Counter()
    codes = ["".join([letters[w] for w in text.split(" ")]) for text in kinds["text"]]
    for code, n in zip(codes, kinds["n"].tolist(), strict=True):
        for i in range(len(code) - window + 1):
            counts[code[i : i + window]] += n
    done, split = set(), bool(kinds["split"].iloc[0])
    for code, text in zip(codes, kinds["text"], strict=True):
        new = [w not in done and (split or counts[w] > 1) and not done.add(w) for w in (code[i : i + window] for i in range(len(code) - window + 1))]
        words, i = text.split(" "), 0
        while True in new[i:]:
            i = new.index(True, i)
            j = i + 1
            while not split and j < len(new) and new[j]:
                j += 1
            yield " ".join(words[i : j + window - 1]), counts[code[i : i + window]]
            i = j


class Digits(dict):
    """Four characters for each block, in order of appearance: its number's digits, each place with characters of its own."""

    def __init__(self) -> None:
        self.codes = map("".join, product(*[[chr(1 + 48 * place + digit) for digit in range(48)] for place in range(4)]))

    def __missing__(self, block: str) -> str:
        self[block] = code = next(self.codes)
        return code


def _blocks(window: int) -> int:
    """Words of a block: the larger one of the window's two divisors nearest to its root, so that a window is a few blocks."""
    return min(b for b in range(1, window + 1) if window % b == 0 and b * b >= window)


def locate(texts: list[str], passages: list[str], window: int, most: int = AUTOMATON_WINDOWS) -> list[set[int]]:
    """For each text the word places where a window of a passage begins, by automata of ``most`` windows each.

    Words are read in blocks, a block as four characters of a small alphabet (nodes look up their children one by one);
    a text is read once from each place in a block.
    """
    per, left, found = _blocks(window), list(passages), [set() for _ in texts]
    split = [t.split(" ") for t in texts]
    while left:
        letters, digits, automaton, n = Letters(), Digits(), ahocorasick.Automaton(), 0
        while left and n < most:
            passage = "".join([letters[w] for w in left.pop().split(" ")])
            blocks = [digits[passage[i : i + per]] for i in range(len(passage) - per + 1)]
            for i in range(len(passage) - window + 1):
                n += automaton.add_word("".join(blocks[i : i + window : per]), True)
        automaton.make_automaton()
        letter, block = letters.get, digits.get
        for words, at in zip(split, found, strict=True):
            code = "".join([letter(w, "\0") for w in words])
            blocks = [block(code[i : i + per], "\0\0\0\0") for i in range(len(code) - per + 1)]
            for phase in range(min(per, len(blocks))):
                at.update([phase + per * (end // 4 + 1) - window for end, _ in automaton.iter("".join(blocks[phase::per]))])
    return found


def repeated_places(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """k1, k2, kept, reach: of each text with a repeated window, the ranges of words (from, to) before repeated ones, and the last repeated one's end.

    k1 and k2 tell a text by 128 bits. Windows are counted over all rows, copies of a text included.
    """
    text = F.col("text").cast("string")
    rows = docs.where(F.length(text) >= 2 * window - 1).select(*_keys(text), text.alias("text"))
    places = written(rows.mapInPandas(_anchored(window, seed), "k1 long, k2 long, anchor long, start int, windows int, h1 long, h2 long"))
    often = checkpointed(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    places = written(places.join(sized(often), "anchor", "left_semi"))
    kind = ["anchor", "h1", "h2"]
    kinds = places.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("source"))
    # the words of a kind are read where it stands first; copies of that text are told apart by nothing, so one will do
    wanted = kinds.groupBy("source.k1", "source.k2").agg(F.collect_list(F.struct(*kind, "n", "source.start", "source.windows")).alias("kinds"))
    wanted = sized(checkpointed(wanted))
    sources = rows.join(wanted, ["k1", "k2"])
    words = lambda t: F.filter(F.split(t, SPACE), lambda w: w != "")
    cut = lambda x: F.transform("kinds", lambda k: F.struct(*[k[c].alias(c) for c in (*kind, "n")], F.array_join(F.slice(x, k["start"] + 1, k["windows"] + window - 1), " ").alias("text")))
    kinds = written(sources.select(F.inline(let(words(F.col("text")), cut))).dropDuplicates(kind))

    shards = spread(kinds.count(), SHARD_KINDS, 1 << 20)
    kinds = kinds.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sizes = kinds.groupBy("shard").agg(F.count("*").alias("many")).where(F.col("many") > PART_KINDS)
    kinds = kinds.join(sized(checkpointed(sizes)), "shard", "left").withColumn("parts", F.ceil(F.coalesce(F.col("many"), F.lit(1)) / PART_KINDS).cast("int"))
    kinds = kinds.select(*kind, "n", "text", "shard", (F.col("parts") > 1).alias("split"), "parts", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int").alias("part"))

    def confirmed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = int(pdf["parts"].iloc[0])
        return pd.DataFrame([(key[0], parts, p, n) for p, n in confirm(pdf, window)], columns=["shard", "parts", "passage", "n"])

    passages = checkpointed(kinds.groupBy("shard", "part").applyInPandas(confirmed, "shard long, parts int, passage string, n long"))
    summed = passages.where("parts > 1").groupBy("shard", "parts", "passage").agg(F.sum("n").alias("n")).where("n > 1")
    passages = passages.where("parts = 1").unionByName(summed).select("shard", "passage", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def located(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = locate(left["text"].tolist(), right["passage"].tolist(), window) if len(left) and len(right) else [()] * len(left)
        out = [(*k, _ranges(sorted(x))) for k, x in zip(zip(*[left[c].tolist() for c in kind], strict=True), at, strict=True) if x]
        return pd.DataFrame(out, columns=[*kind, "at"])

    found = kinds.groupBy("shard", "part").cogroup(passages.groupBy("shard", "part")).applyInPandas(located, "anchor long, h1 long, h2 long, at array<struct<a: int, b: int>>")
    found = sized(checkpointed(found))
    spans = places.join(found, kind).select("k1", "k2", "start", F.explode("at").alias("x")).select("k1", "k2", (F.col("start") + F.col("x.a")).alias("a"), (F.col("start") + F.col("x.b") + window).alias("b"))
    spans = spans.groupBy("k1", "k2", "a").agg(F.max("b").alias("b"))
    reach = F.coalesce(F.max("b").over(Window.partitionBy("k1", "k2").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("reach", reach)
    gap = F.when(F.col("a") > F.col("reach"), F.struct(F.col("reach").alias("from"), F.col("a").alias("to")))
    return checkpointed(spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(gap)).alias("kept"), F.max("b").alias("reach")))


def _ranges(at: list[int]) -> list[tuple[int, int]]:
    """First and last of each row of consecutive places."""
    out = []
    for i in at:
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def without_repeated_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with only those words in ``text`` that no repeated window covers, joined by a space, and n_words and n_removed.

    A window is repeated if its words also begin anywhere else, in the same document too; all places of it go, the first
    included. A null text has no words and stays null; rows that repeat a text of ``window`` words lose it whole. Columns of
    ``docs`` pass through a struct, so their names do no harm; columns n_words and n_removed are replaced. An empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("text").cast("string").alias("text"))
    packed = packed.select("_doc", "text", *_keys(F.col("text")))
    out = packed.join(sized(repeated_places(docs.select("text"), window, seed)), ["k1", "k2"], "left")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != "")
    kept = lambda x: F.when(F.col("reach").isNull(), x).otherwise(F.concat(F.flatten(F.transform("kept", lambda g: F.slice(x, g["from"] + 1, g["to"] - g["from"]))), F.slice(x, F.col("reach") + 1, F.size(x))))
    left = lambda x: let(kept(x), lambda y: F.struct(F.size(x).cast("long").alias("n_words"), (F.size(x) - F.size(y)).cast("long").alias("n_removed"), F.array_join(y, " ").alias("text")))
    out = out.select("_doc", "text", let(words, left).alias("_left"))
    text = F.when(F.col("text").isNotNull(), F.col("_left.text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in names], "_left.n_words", "_left.n_removed")
