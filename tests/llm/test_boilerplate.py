"""Lines above the limits leave the kept texts."""

from lexmill.llm import quality


def test_kept_documents_lose_lines_above_the_limits(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Menu  One\n{own(i)}\n \n\tmenu one\nlast{i}", "hot", 1) for i in range(12)]
    rows += [(100, f"Menu One\n{own(100)}", "cold", 1), (101, f"Menu One\n{own(101)}", None, 1), (102, own(102), "hot", 7)]
    rows += [rows[0]]
    got = quality.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(3), line_docs=10)
    want = [(i, t := f"{own(i)}\n \nlast{i}", "hot", len(t)) for i in range(12)] + rows[12:15]
    assert sorted(map(tuple, got.collect())) == sorted([*want, want[0]])


def test_limits_are_shares_and_depleted_documents_go(spark):
    own = lambda i, n=60: " ".join(f"w{i}x{k}" for k in range(n))
    menu = " ".join(f"m{k}" for k in range(60))
    rows = [(i, f"{menu}\n{own(i, 5 if i < 3 else 60)}", "a") for i in range(12)]
    rows += [(20 + i, f"{menu}\n{own(20 + i)}", "b") for i in range(5)]  # the count guards small hosts
    # one line stands in 1 % of a host's texts, another in a little more
    rows += [(100 + i, own(100 + i) + ("\none line" if i < 6 else "\nother line" if i < 13 else ""), "c") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.line_frequency_rules(docs).collect()}
    assert {i for i, r in got.items() if not r.base_failed and not r.kept} == {0, 1, 2}
    assert {i for i, r in got.items() if r.removed_lines} == {*range(12), *range(106, 113)}
    texts = {r.doc_id: r.text for r in quality.kept_documents(docs).collect()}
    assert set(texts) == set(got) - {0, 1, 2}
    assert texts[5] == own(5) and texts[21] == f"{menu}\n{own(21)}" and texts[100].endswith("one line") and texts[106] == own(106)
