"""Language profiles, out-of-place distances, license places and spans against plain loops."""

import random
import re
from collections import Counter

import numpy as np

from lexmill.llm import language, licenses

SIZE = 30


def pieces(text):
    """N-grams as strings, boundaries as a bar."""
    out, low = [], ""
    for c in text:
        low += (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "|"
    x = re.sub(r"\|+", "|", f"|{low}|")
    for k in (1, 2, 3):
        out += [g for i in range(len(x) - k + 1) if (g := x[i : i + k]) not in ("|", "||") and (k < 3 or g[1] != "|")]
    return Counter(out)


def code(gram):
    return sum((1 if c == "|" else ord(c)) << 21 * i for i, c in enumerate(gram))


def first(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda t: (-t[1], code(t[0])))][:size]


def judged(text, learned, size):
    own = first(pieces(text or ""), size)
    if not text or not own:
        return "und", 0.0
    away = {lang: sum(abs(p.index(g) - i) if g in p else size for i, g in enumerate(own)) for lang, p in learned.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (size * len(own))


def corpus(rnd):
    words = {"aa": "der die das und nicht über ça", "bb": "the and that of with not ça", "cc": "le la les et dans ça é"}
    rows = []
    for i in range(160):
        lang = rnd.choice(list(words))
        text = " ".join(rnd.choice(words[lang].split() + ["x1y", "İx", "中文", "..", "ß"]) for _ in range(rnd.randint(0, 25)))
        rows.append((i, rnd.choice([text, text, text.upper(), text * 3]), rnd.choice([lang, lang, None])))
    return rows + [(161, None, "aa"), (162, "", "bb"), (163, "12 .. !", "cc"), (164, "der der", "aa"), (164, "der der", "aa"), (None, "the and", "bb")]


def test_language_equals_plain_profiles_and_distances(spark):
    from zlib import crc32

    rows = corpus(random.Random(10))
    out = lambda i: crc32(str("" if i is None else i).encode()) % 3 == 1
    learned = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not out(i):
            learned.setdefault(lang, Counter()).update(pieces(text))
    learned = {lang: first(c, SIZE) for lang, c in learned.items()}
    got = language.rank_order_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), SIZE).collect()
    want = [(i, out(i), *judged(text, learned, SIZE)) for i, text, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got), key=key) == sorted(((i, o, p, round(s, 9)) for i, o, p, s in want), key=key)


def test_ties_go_to_the_first_name():
    learned = {k: np.array([code(g) for g in first(pieces("der"), SIZE)], "u8") for k in ("zz", "mm")}
    assert language.Judge(learned, SIZE)("der")[0] == "mm"


def test_base_places_equal_plain_counts(spark):
    rnd = random.Random(8)
    parts = ["MIT", "mit", "License", "license", "licensé", "apache", "general", "public", "GENERAL PUBLIC LICENSE", "the", "Mit-License", "x"]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice([" ", "\n", "-", ", ", "", " \x00", "é", " "]) for _ in range(rnd.randint(0, 40)))) for i in range(120)] + [(200, None), (201, "")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), items=()).collect()}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = [(k, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p]
        at = [k for k, _ in found]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in found}))), text
        assert r.labels == r.base_labels and r.score == (1.0 if at else 0.0)


def distances(notice: bytes, text: bytes):
    """Edits between ``notice`` and each prefix of ``text``."""
    row = np.arange(len(text) + 1)
    out = row.copy()
    for i, c in enumerate(notice, 1):
        new = np.empty_like(out)
        new[0] = i
        for j in range(1, len(text) + 1):
            new[j] = min(out[j] + 1, new[j - 1] + 1, out[j - 1] + (text[j - 1] != c))
        out = new
    return out


def test_spans_are_all_occurrences_within_the_errors(spark):
    rnd = random.Random(12)
    items = (("mit", "released under the mit license"), ("reserved", "all rights reserved"), ("cc", "licensed under cc by nc 4 0"))
    rows = []
    for i in range(30):
        words = []
        for _ in range(rnd.randint(1, 4)):
            text = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(text))
                text[k] = rnd.choice(["", "q", text[k] + "q", text[k]])
            words += ["".join(text), *rnd.choices(["zz", "under", "rights", "the mit"], k=rnd.randint(0, 4))]
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), items=items).collect()}
    some = 0
    for i, text in rows:
        words = text.encode().split()
        spans = [(s.label, s.first_word, s.last_word, s.edits) for s in got[i].spans]
        for label, notice in items:
            most = max(1, len(notice) // licenses.ERROR_CHARS)
            fits = {}
            for a in range(len(words)):
                joined = b" ".join(words[a:])[: len(notice) + most + 20]
                away = distances(notice.encode(), joined)
                for b in range(a, len(words)):
                    size = len(b" ".join(words[a : b + 1]))
                    if size <= len(joined) and away[size] <= most:
                        fits[a, b] = int(away[size])
            mine = [(a, b, e) for lab, a, b, e in spans if lab == label]
            assert all(fits.get((a, b)) is not None and e >= fits[a, b] and e <= most for a, b, e in mine), (text, mine, fits)
            assert all(any(x <= b and a <= y for x, y, _ in mine) for a, b in fits), (text, mine, fits)
            some += len(mine)
        assert got[i].labels == ",".join(sorted({s[0] for s in spans} | set(filter(None, got[i].base_labels.split(",")))))
    assert some > 25
