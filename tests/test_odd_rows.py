"""Queries against their DuckDB twins on rows that the given tables don't have."""

import duckdb
import pytest
from test_queries import plain

from lexmill.operators import chunking, exam
from lexmill.plans import queries

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def twins(spark, folder, name, table, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return plain(got), plain(want)


@pytest.mark.parametrize("text", ["Mente quelles.\nLas las ?", "Quelle est ?\nA. oui\nDonnez", "a", "", "  ", None, "un\rdeux quels\nA- x", "\r\n x"])
def test_question_split_asks_nothing_in_the_narrative(spark, tmp_path, text):
    rows = [(i, t, r, text) for i, (t, r) in enumerate([(0, "user"), (1, "user"), (2, "assistant"), (6, "quel"), (2, None), (None, "user")])]
    if text and "\r" in text.strip():
        rows = rows[1:2]  # a first line that itself is several lines is joined by newlines where it is an option
    got, want = twins(spark, tmp_path, "question_split", "conversations", "conv_id long, turn long, role string, text string", rows)
    assert got == want


def test_question_split_with_a_preamble(spark):
    rows = spark.createDataFrame([("Quel cas ?\nA. x", "Patient.\nQuelle ?\nA. a\nLequel ?\nB. b"), ("", "Quelle ?\nA. a\nLequel ?\nB. b"), (None, "Quelle ?\nA. a\nLequel ?\nB. b"), ("Quel cas ?", "Quelle ?\nA. a")], "p string, m string")
    got = [r[0] for r in rows.select(exam.split_questions(rows["m"], preamble=rows["p"])).collect()]
    lead = "Quel cas ?\nA. x\nPatient."
    assert got == [[f"{lead}\n\nQuelle ?\nA. a", f"{lead}\n\nLequel ?\nB. b"], ["\n\nQuelle ?\nA. a", "\n\nLequel ?\nB. b"], ["Quelle ?\nA. a", "Lequel ?\nB. b"], ["Quel cas ?\nQuelle ?\nA. a"]]


@pytest.mark.parametrize("text", ["", " \n", None, "un <!--loc:page=7--> deux", "<!--loc:section=x-->", "a"])
def test_located_stretches_of_blank_and_marked_texts(spark, tmp_path, text):
    rows = [(i, text, lang, source, 0) for i, (lang, source) in enumerate([("en", "src1"), ("", "src1"), (None, "src1"), ("en", None), ("en", ""), (" ", " "), ("<!--loc:page=1-->", "s")])]
    got, want = twins(spark, tmp_path, "located_stretches", "documents", DOCUMENTS, [*rows, (None, text, "en", "src1", 0)])
    assert len(want) == 24 and got == want


@pytest.mark.parametrize("text", ["", " \n", None, " src1 > en", "a "])
def test_context_prefix_of_blank_texts(spark, tmp_path, text):
    named = [("en", "src1"), (None, "src1"), ("en", None), ("en", ""), ("", " s"), ("", "")]
    rows = [(6 * k + i, text, lang, source, 0) for k, (lang, source) in enumerate(named) for i in range(6)]
    got, want = twins(spark, tmp_path, "context_prefix", "documents", DOCUMENTS, [*rows, (None, text, "en", "src1", 0)])
    assert len(want) == 36 and got == want


def test_text_to_embed(spark):
    rows = spark.createDataFrame([("p", "s", "t"), ("p", None, ""), ("", "", "t"), (None, "s", " "), ("p", "s", None)], "p string, s string, t string")
    assert [r[0] for r in rows.select(chunking.enrich(rows["t"], rows["p"], rows["s"])).collect()] == ["p s t", "p ", "t", "s  ", None]


def test_paged_documents_in_volumes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "VOLUME_PAGES", 3)
    sources = ["src1"] * 6 + ["", "a/b", "x=1%2F+ é", "007", "7", None]
    rows = [(None if i == 57 else 97 * i % 60, ["a\n b \n\nc", "", "x\fy", None][min(i % 9, 3)] if i % 9 < 4 else f"t{i}", "en", sources[i % 12], 0) for i in range(60)]
    got, want = twins(spark, tmp_path, "paged_documents", "documents", DOCUMENTS, rows)
    assert len({r[2] for r in want}) == 6 and got == want
