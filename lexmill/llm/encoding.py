"""Byte-pair encoding of whole texts by tree concatenation, and decoding.

Every text is halved until its parts are leaves; leaves are encoded on their own, and neighbours are joined up the
tree. Of a long text the upper halves are dealt out, so that parallel tasks build their parts of the tree. At a join a window around it is encoded anew and grown until, on both sides,
it cuts the text where the parts' own encodings do; from there on both agree, so the parts' ids can be kept. Inside
a single pre-token that spans the join (text that nothing splits), the window is one of ids: once its first and
last id are those the parts have, all neighbours in the row of ids are stable and the row is the encoding.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import bpe

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a leaf.
LEAF = 1_024
#: Characters of a long text that one task takes at a time.
SHARE = 32_768
#: No pre-token rule looks further ahead than this, and no special token is longer.
MARGIN = 32
#: A pre-token from this size on is joined by windows of ids.
LONG = 512


class Part:
    """The exact encoding of a stretch of text: pre-token lengths in characters, and packed ids of each."""

    def __init__(self, text: str, pretokens: list[str], ids: list[bytes]):
        self.text, self.pretokens, self.ids = text, pretokens, ids


def leaf(encoder: bpe.Bpe, text: str) -> Part:
    cut = encoder.pretokens(text)
    encoder.cache.trim()
    return Part(text, cut, list(map(encoder.cache.__getitem__, cut)))


def join(encoder: bpe.Bpe, left: Part, right: Part) -> Part:
    """The exact encoding of both texts together."""
    text, width = left.text + right.text, MARGIN
    while True:
        # a pre-token start at least `width` before the join
        i, a = len(left.pretokens), 0
        while i and a < width:
            i -= 1
            a += len(left.pretokens[i])
        # a pre-token end at least `width` after it, and a margin beyond
        j = b = 0
        while j < len(right.pretokens) and b < width:
            b += len(right.pretokens[j])
            j += 1
        end = min(len(right.text), b + MARGIN)
        window = left.text[len(left.text) - a :] + right.text[:end]
        cut, at, ends = encoder.pretokens(window), 0, None
        if end == len(right.text):
            ends, j = len(cut), len(right.pretokens)
        else:
            for n, piece in enumerate(cut):
                at += len(piece)
                if at == a + b:
                    ends = n + 1
                    break
        if ends is not None:
            old = left.pretokens[i:], right.pretokens[:j]
            ids = [middle(encoder, p, old, (left.ids[i:], right.ids[:j])) for p in cut[:ends]]
            return Part(text, left.pretokens[:i] + cut[:ends] + right.pretokens[j:], left.ids[:i] + ids + right.ids[j:])
        width *= 2


def middle(encoder: bpe.Bpe, pretoken: str, old: tuple[list[str], list[str]], ids: tuple[list[bytes], list[bytes]]) -> bytes:
    """Ids of a window's pre-token; one that is both parts' end and start grown together keeps their ids but for a window."""
    if len(pretoken) >= LONG and old[0] and old[1] and pretoken == old[0][-1] + old[1][0]:
        return grown(encoder, np.frombuffer(ids[0][-1], "<u4"), np.frombuffer(ids[1][0], "<u4")).tobytes()
    return encoder.cache[pretoken]


def grown(encoder: bpe.Bpe, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of two stretches of one pre-token together: a window of ids around the join, grown until its ends agree."""
    width = 4
    while True:
        a, b = left[max(0, len(left) - width) :], right[:width]
        raw = b"".join(encoder.pieces[i] for i in (*a, *b))
        new = encoder.bytes_ids(raw)
        first = len(a) == len(left) or new[0] == a[0] and len(new) > 1
        last = len(b) == len(right) or new[-1] == b[-1] and len(new) > 1
        if first and last:
            return np.concatenate([left[: len(left) - len(a)], new, right[len(b) :]])
        width *= 2


def tree(encoder: bpe.Bpe, parts: list[Part]) -> Part:
    """Joins neighbours level by level."""
    while len(parts) > 1:
        parts = [join(encoder, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encoded(encoder: bpe.Bpe, text: str, leaf_chars: int = LEAF) -> Part:
    """The exact encoding of a text, from its leaves up."""
    return tree(encoder, [leaf(encoder, part) for part in halves(text, leaf_chars)])


def halves(text: str, size: int) -> list[str]:
    """The leaves of a text: halved until no part is longer than ``size``."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], size) + halves(text[mid:], size)


def encode_decode(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF, share: int = SHARE, ids: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, and the decoded text) of every row.

    Null texts count as empty; an empty text has no ids. Repeated rows are encoded each; no rows give no rows;
    further columns are not looked at. Texts of more than ``share`` characters are dealt out in halves of halves up to
    that size, so that one very long text keeps several tasks busy; then each such text's ids meet in one task.
    """
    path = path or bpe.public_path(VOCABULARY)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids + ", decoded string" * decoded
    names = [x.split()[0] for x in schema.split(", ")]

    def digest(encoder, doc, blob, digits) -> list:
        row = np.frombuffer(blob, "<u4").tolist()
        back = encoder.decode(row)
        out = [doc, len(row), hashlib.sha256(",".join(map(digits.__getitem__, row)).encode()).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()]
        return out + [row] * ids + [back] * decoded

    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64())] * ids + [pa.string()] * decoded

    def short(batches):
        encoder = bpe.load(path)
        digits = [str(i) for i in range(len(encoder.pieces))]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [digest(encoder, d, b"".join(encoded(encoder, t or "", leaf_chars).ids), digits) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def leaves(batches):
        encoder = bpe.load(path)
        for batch in batches:
            for row, doc, k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = encoded(encoder, text, leaf_chars)
                sizes = [len(p) for p in x.pretokens]
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([doc], pa.int64()), pa.array([k], pa.int32()), pa.array([text]), pa.array([sizes], pa.list_(pa.int32())), pa.array([[len(i) // 4 for i in x.ids]], pa.list_(pa.int32())), pa.array([b"".join(x.ids)], pa.binary())], names=["_row", "doc_id", "_leaf", "_text", "_chars", "_counts", "_ids"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = bpe.load(path)
        digits = [str(i) for i in range(len(encoder.pieces))]
        parts = []
        for text, chars, counts, blob in pdf.sort_values("_leaf")[["_text", "_chars", "_counts", "_ids"]].itertuples(index=False):
            to, by = np.cumsum(chars), 4 * np.cumsum(counts)
            parts.append(Part(text, [text[a - n : a] for a, n in zip(to, chars, strict=True)], [blob[a - 4 * n : a] for a, n in zip(by, counts, strict=True)]))
        return pd.DataFrame([digest(encoder, int(pdf["doc_id"].iloc[0]) if pd.notna(pdf["doc_id"].iloc[0]) else None, b"".join(tree(encoder, parts).ids), digits)], columns=names)

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the upper halves, in the JVM: 2^depth parts whose borders halve the length again and again
    long = both.where(F.length("text") > share).withColumn("_row", F.monotonically_increasing_id())
    depth = F.ceil(F.log2(F.length("text") / F.lit(float(share)))).cast("int")
    long = long.withColumn("_n", F.pow(F.lit(2), depth).cast("long"))
    border = lambda k: F.floor(F.length("text").cast("long") * k / F.col("_n")).cast("int")
    # all parts of a row are cut at once: the rows that are dealt out carry a part each, never the text
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda k: F.substring("text", border(k) + 1, border(k + 1) - border(k)))
    long = long.select("_row", "doc_id", F.posexplode(cut).alias("_leaf", "_text"))
    long = long.repartition("_row", "_leaf").mapInArrow(leaves, "_row long, doc_id long, _leaf int, _text string, _chars array<int>, _counts array<int>, _ids binary")
    whole = long.groupBy("_row").applyInPandas(together, schema)
    return both.where(F.length("text") <= share).select("doc_id", "text").mapInArrow(short, schema).unionByName(whole)
