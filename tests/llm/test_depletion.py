"""Documents that pass the word rules but consist of a host's boilerplate, against the operator's SQL."""

import duckdb
import pandas as pd

from lexmill.llm import quality


def test_depleted_documents_are_rejected_as_in_sql(spark):
    line = lambda key, n: " ".join(f"{key}w{i}" for i in range(n))
    shared = [line(f"s{k}", 15) for k in range(6)]
    rows = []
    for i in range(80):
        own = [line(f"d{i}x{k}", 12) for k in range(3)]
        # all boilerplate but 12 words; some boilerplate; none; another host's own lines that only look alike
        text = ([*shared, own[0]], [*shared[:2], *own, line(f"e{i}", 30)], [*own, line(f"f{i}", 40)], [shared[0].upper(), *own, line(f"g{i}", 30)])[i % 4]
        rows.append((i, "\n".join(text), ("a.org", "b.org")[i % 8 > 3], "x"))
    rows += [(100, "\n".join(shared), None, "x"), (101, None, "a.org", "x"), (102, rows[0][1], "a.org", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    out = quality.line_frequency_rules(docs.drop("host")).drop("row_id", "host", "text_hash", "removed_lines").toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "source"]))
    want = con.sql(quality.ORACLE).df()
    sort = lambda x: x[want.columns].sort_values(["doc_id", "n_words"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(out), sort(want), check_dtype=False)
    depleted = out[~out["base_failed"] & ~out["kept"]]
    assert set(depleted["doc_id"]) == {i for i in range(80) if i % 4 == 0} | {102}
    kept = quality.kept_documents(docs).collect()
    assert {r.doc_id for r in kept} == set(out[out["kept"]]["doc_id"]) and all(shared[0] not in r.text for r in kept if r.doc_id % 4 == 1)
