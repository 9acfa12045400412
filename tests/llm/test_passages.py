import random
import re
from collections import Counter

import pytest

from lexmill.llm import passages as P
from tests_data import EDGE_ROWS, EDGE_SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    """(words, removed, text) of each text, by counting every window."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w, text in zip(words, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), None if text is None else " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, window, seed):
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, n_words long, _doc long")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in P.without_repeated_passages(df, window, seed).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


@pytest.mark.parametrize(("window", "seed", "parts"), [(6, 2, 6_000), (6, 3, 5), (12, 8, 6_000), (5, 5, 4)])
def test_equals_brute_force(spark, monkeypatch, window, seed, parts):
    monkeypatch.setattr(P, "PART_KINDS", parts)
    monkeypatch.setattr(P, "SHARD_KINDS", 20)
    rng = random.Random(window * seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["é", " x", "x"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [say(rng.randint(window - 2, 3 * window)) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts_ = [x for _ in range(rng.randint(0, 3)) for x in (say(rng.randint(0, 15)), rng.choice(shared))] + [say(rng.randint(0, 15))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for p in parts_ for w in p))
    texts += [None, "", " \n", texts[0], texts[0], "a " * 40, "a " * 3 * window, "b", " ".join(say(300))]
    # one passage in a third of all texts, with other words around it
    texts += [" ".join(say(4) + shared[0] + say(4)) for _ in range(40)]
    check(spark, texts, window, seed)


def test_edges(spark):
    df = spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
    out = P.without_repeated_passages(df)
    assert out.columns == [*df.columns, "n_words", "n_removed"]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out.where("text IS NOT NULL").collect())
    texts = [r[1] for r in EDGE_ROWS]
    assert got == sorted((r[0], *b) for r, b in zip(EDGE_ROWS, brute(texts, P.WINDOW), strict=True) if r[1] is not None)
    assert P.without_repeated_passages(df.where("false")).count() == 0
    assert P.without_repeated_passages(df.where("text IS NULL")).count() == 2


def test_automata_of_any_size_find_the_same():
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    texts, phrases = [say(60) for _ in range(5)], [say(rng.randint(3, 6)) for _ in range(12)]
    want = [{i for i in range(58) if any(" ".join(t.split(" ")[i : i + 3]) in {" ".join(p.split(" ")[j : j + 3]) for j in range(len(p.split(" ")) - 2)} for p in phrases)} for t in texts]
    for most in (1, 4, 100):
        assert P.locate(texts, phrases, 3, most) == want
