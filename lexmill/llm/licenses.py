"""License scan: exact phrases, and fuzzy short notices found by exact seeds and verified with bounded errors."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose exact places count, and short notices that are searched with errors.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
#: One error for so many characters of a notice, at least one.
ERROR_CHARS = 14

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Notice:
    """A notice with its seeds: k errors leave one of k + 1 pieces unharmed."""

    def __init__(self, label: str, text: str, error_chars: int = ERROR_CHARS):
        self.label, self.text, self.errors = label, text.encode(), max(1, len(text) // error_chars)
        cuts = [round(i * len(self.text) / (self.errors + 1)) for i in range(self.errors + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(rb"(?e)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(self.text, special_only=True, literal_spaces=True), self.errors))

    def windows(self, joined: bytes) -> list[tuple[int, int]]:
        """The stretches, merged, in which an occurrence must lie."""
        found = []
        for offset, seed in self.seeds:
            at = joined.find(seed)
            while at >= 0:
                found.append((max(0, at - offset - self.errors - 1), at - offset + len(self.text) + self.errors + 1))
                at = joined.find(seed, at + 1)
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged]

    def search(self, joined: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the occurrences, left to right without overlap."""
        return [(m.start(), m.end(), sum(m.fuzzy_counts)) for a, b in self.windows(joined) for m in self.pattern.finditer(joined, a, min(b, len(joined)))]


@lru_cache(maxsize=8)
def notices(error_chars: int, items: tuple) -> list[Notice]:
    return [Notice(label, text, error_chars) for label, text in items]


def joined_words(text: str | None) -> tuple[bytes, int]:
    """The text's words, lower-cased, with a space before and after each; and their number."""
    words = (text or "").encode("utf-8", "replace").translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The words, from 0, at which the phrase starts."""
    out, at, spaces, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        spaces += joined.count(b" ", seen, at)
        seen = at
        out.append(spaces)
        at = joined.find(phrase, at + 1)
    return out


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, items: tuple = NOTICES, error_chars: int = ERROR_CHARS, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (and spans) of every row.

    score: 1 with an exact phrase, else 1 less the edits' share of the notice's length, 0 with no notice. spans:
    label, first and last word, edits of every notice found. Null and empty texts have no words and no labels;
    repeated rows are scanned each; an empty table gives no rows; texts are searched whole; only doc_id and text
    are read.
    """
    phrases = {f" {p} ".encode(): label for p, label in (phrases or PHRASES).items()}
    struct = "array<struct<label: string, first_word: long, last_word: long, edits: int>>"
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + f", spans {struct}" * spans
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()] + [span] * spans
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] + ["spans"] * spans

    def scan(batches):
        known = notices(error_chars, tuple(items))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                joined, n = joined_words(text.as_py())
                starts, base, labels, found, score = [], set(), set(), [], 0.0
                for phrase, label in phrases.items():
                    if at := places(joined, phrase):
                        starts += at
                        base.add(label)
                        score = 1.0
                for notice in known:
                    first, seen = -1, 0  # words are counted once along a text, whatever its notices
                    for a, b, edits in notice.search(joined):
                        labels.add(notice.label)
                        score = max(score, 1 - edits / len(notice.text))
                        first, seen = first + joined.count(b" ", seen, a), a
                        found.append({"label": notice.label, "first_word": first, "last_word": first + joined.count(b" ", a, b), "edits": edits})
                row = (doc, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)
                rows.append(row + (found,) * spans)
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)
