"""Quality rules, language profiles, license scan and url filter against brute force."""

import random
import re
from collections import Counter

import numpy as np
import regex

from lexmill.llm import language, licenses, quality, urls
from tests_data import EDGE_ROWS, EDGE_SCHEMA


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a ", "b ", "c\n", "c ", "#", "é ", "\t", "\n", " "]) for _ in range(rnd.randrange(60))) for _ in range(200)]
    texts += [r[1] for r in EDGE_ROWS]
    docs = spark.createDataFrame([(i, t, "s", "extra") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words string")
    got = quality.line_frequency_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == [(i, *brute_measures(t)) for i, t in enumerate(texts)]
    assert quality.line_frequency_rules(docs.limit(0)).count() == 0


def test_depleted_documents_go_and_others_stay(spark):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    line = " ".join(f"menu{k}" for k in range(60))
    rows = [(i, f"{line}\n{own(i, 5)}", "hot", "x") for i in range(30)]  # mostly a common line
    rows += [(100 + i, f"{line}\n{own(i, 100)}", "hot", "x") for i in range(5)]  # holds it too
    rows += [(200 + i, own(7, 80), "hot", "x") for i in range(30)]  # exact copies count once
    rows += [(300, f"{line}\n{own(300, 5)}", "other", "x"), (301, f"{line}\n{own(300, 5)}", None, "x")]  # other hosts
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string")
    kept = quality.kept_documents(docs, line_docs=10)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [*range(100, 105), *range(200, 230), 300, 301]


def test_language_steps_and_profiles(spark, monkeypatch):
    rnd = random.Random(4)

    def brute(text):
        x = re.sub("\1+", "\1", "\1" + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\1" for c in text) + "\1")
        grams = [x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)]
        return Counter(g for g in grams if g.strip("\1") and (len(g) < 3 or g[1] != "\1"))

    for step in (1 << 20, 3, 7):
        monkeypatch.setattr(language, "STEP", step)
        for _ in range(200):
            text = "".join(rnd.choice("aBé .1ß\nÇzİ中") for _ in range(rnd.randrange(40)))
            codes, counts = language.grams(text)
            assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {sum(ord(c) << 21 * k for k, c in enumerate(g)): n for g, n in brute(text).items()}


def test_language_rows(spark):
    rows = [(i, "the cat and the dog were there with the others " * 3, "en", "x") for i in range(40)]
    rows += [(100 + i, "der Hund und die Katze waren nicht dort mit den anderen " * 3, "de", "x") for i in range(40)]
    rows += [(200, None, "en", "x"), (201, "123 !!", "de", "x"), (202, "", None, "x"), (None, "und nicht", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.rank_order_language(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "en" and got[100 + i].lang_pred == "de" for i in range(40))
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.rank_order_language(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = language.rank_order_language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def edited(rnd, text, errors):
    out = list(text)
    for _ in range(errors):
        k, what = rnd.randrange(1, len(out) - 1), rnd.randrange(3)
        if what == 0:
            out[k] = "q"
        elif what == 1:
            del out[k]
        else:
            out.insert(k, "q")
    return "".join(out)


def test_fuzzy_notices_are_found_where_the_whole_text_search_finds_them():
    rnd = random.Random(9)
    for label, text in licenses.NOTICES:
        notice = licenses.Notice(label, text)
        whole = regex.compile(notice.pattern.pattern)
        for _ in range(25):
            noise = lambda: " ".join(rnd.choice(text.split() + ["zz", "other"]) for _ in range(rnd.randrange(12)))
            joined, _ = licenses.joined_words(f"{noise()} {edited(rnd, text, rnd.randrange(notice.errors + 2))} {noise()}")
            assert bool(notice.search(joined)) == bool(whole.search(joined))


def test_license_rows(spark):
    rows = [(1, "Released under the MIT License. MIT-license!", 1), (2, "the permit license", 1), (3, None, 1), (4, "", 1), (5, "Licensed under the Apach License, Version 2.0", 1), (6, "GNU General Public License général", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 3, 5, "mit", "mit")
    assert (got[2].n_base, got[2].first_word, got[2].labels) == (0, None, "")
    assert got[3].n_words == got[4].n_words == 0 and got[3].labels == ""
    assert (got[5].base_labels, got[5].labels, got[5].spans[0].edits) == ("", "apache", 1) and 0.9 < got[5].score < 1
    assert (got[6].base_labels, got[6].n_words, got[6].first_word) == ("gpl", 5, 1)
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_url_rows(spark):
    rows = [
        (1, "HTTP://WWW.Example.com/en/a?b#c"), (2, "http://example.com/en/x"), (3, "http://example.com"), (4, "https://a.example.com/fr"), (5, None), (6, "no url"),
        (7, "x://y.net/es/1"), (8, "x://y.net/en/1"), (9, "http://notexample.com/en/"), (10, "a://b.org/?x://c"), (11, "http://É.com/ÉA"),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.url_filter(docs).collect()}
    want = {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("example.com", "/en/x", "example.com/en/", "block"), 3: ("example.com", "", None, None),
        4: ("a.example.com", "/fr", "com/", "allow"), 5: ("", "", None, None), 6: ("", "", None, None), 7: ("y.net", "/es/1", "net/es/", "block"),
        8: ("y.net", "/en/1", None, None), 9: ("notexample.com", "/en/", "com/", "allow"), 10: ("b.org", "/", None, None), 11: ("É.com", "/ÉA", "com/", "allow"),
    }
    for k, (host, path, rule, verdict) in want.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert urls.url_filter(docs.limit(0)).count() == 0
    one_class = urls.url_filter(docs.where("page_id IN (4, 8)")).collect()
    assert all(r.verdict == "allow" for r in one_class)


def test_url_models_learn_the_difference(spark):
    rows = [(i, f"http://s{i}.shop.com/fr/good/{i}") for i in range(60)] + [(100 + i, f"http://s{i}.spam.net/es/casino/{i}") for i in range(60)]
    rows += [(300, "http://s.shop.org/fr/good/9"), (301, "http://s.spam.org/es/casino/9")]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[300], got[301]) == ("allow", "block")


def test_url_scores_are_those_of_exact_counts(spark):
    rnd = random.Random(5)
    tail = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(70))
    read = [(f"s.com/{tail()}", "allow") for _ in range(1500)] + [(f"s.net/es/{tail()}", "block") for _ in range(1500)]
    read += read[:40] + [(f"s.org/{tail()}", None) for _ in range(200)]

    def grams(text):
        x = [-1] * 4 + list(text.encode()) + [0]
        return [[(k, *x[i - k : i + 1]) for k in range(5)] for i in range(4, len(x))]

    pages = spark.createDataFrame([(i, f"x://{text}") for i, (text, _) in enumerate(read)], "page_id long, url string").repartition(5)
    got = {r.page_id: r for r in urls.url_filter(pages).collect()}
    assert len(got) == len(read)
    held = [got[i].held_out for i in range(len(read))]
    assert 450 < sum(held) < 750 and not any(h for h, (_, ruled) in zip(held, read, strict=True) if not ruled)

    counts = {"allow": Counter(), "block": Counter()}
    for (text, ruled), out in zip(read, held, strict=True):
        if ruled and not out:
            counts[ruled].update(g for place in grams(text) for g in place)
    totals, kinds = ({c: Counter() for c in counts} for _ in range(2))
    for c, own in counts.items():
        for g, n in own.items():
            totals[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1

    def log_p(c, place):
        p = 1 / 256
        for g in place:
            if n := totals[c][g[:-1]]:
                p = (counts[c][g] + kinds[c][g[:-1]] * p) / (n + kinds[c][g[:-1]])
        return np.log(max(p, 1e-12))  # the models' least likelihood

    ratio = [np.mean([log_p("allow", x) - log_p("block", x) for x in grams(text)]) for text, _ in read]
    fit = {c: [r for r, (_, ruled), out in zip(ratio, read, held, strict=True) if out and ruled == c] for c in counts}
    (am, asd), (bm, bsd) = ((np.mean(v), np.std(v)) for v in (fit["allow"], fit["block"]))
    threshold = (am * bsd + bm * asd) / (asd + bsd)
    for i, (_, ruled) in enumerate(read):
        assert abs(got[i].score - (ratio[i] - threshold)) < 1e-6
        assert got[i].verdict == (ruled or ("allow" if got[i].score >= 0 else "block"))
