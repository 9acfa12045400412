"""Retrieval with parents and a reranker, and what its texts go through."""

import random
import re

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import chunking, models, retrieval


def test_strip_is_what_its_pattern_says(spark):
    rnd = random.Random(3)
    signs = [*tx.SPACES, "a", "é", "𝄞", "\u200b", "\x1b", "\x00"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(8))) for _ in range(2000)] + [None, "", *signs]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(tx.strip(F.col("t")), F.regexp_replace("t", tx.STRIP, "")).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [t if t is None else t.strip() for t in texts]


def test_units_and_stretches_with_and_without_marks(spark):
    rnd = random.Random(4)
    signs = ["a", "b.", "? ", " ", "\n", "• ", " ⇒", "① ", "\u00a0", "<!--loc:page=2-->", "<!--"]
    texts = ["".join(rnd.choice(signs[: 5 if i % 2 else 11]) for _ in range(rnd.randrange(30))) for i in range(1000)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", chunking.split_units(F.col("t")), chunking.locate(F.col("t"))).collect()
    unit = re.compile(r"\n+|(?<=[.!?])\s+|(?=\s*[•▪◦⇒⇨]\s)|(?=\s*[①-⑳]\s)")
    for t, units, stretches in got:
        assert (units, stretches) == (None, None) if t is None else units == [u.strip() for u in unit.split(t.strip()) if u.strip()]
        if t is not None:
            assert [s.text for s in stretches] == ([s for s in t.split("<!--loc:page=2-->") if s.strip()] or [t])


def test_only_the_pools_parents_are_judged(spark):
    """Texts of parents that no query meets are never looked at: here they would fail."""
    vector = lambda i: [1.0, i / 100]
    chunks = spark.createDataFrame([(f"c{i:03}", f"p{i // 2:02}", vector(i), None) for i in range(300)], "chunk_id string, parent_id string, vector array<float>, kind string")
    judged = F.when(F.col("i") < 140, F.concat(F.lit("Un texte assez long du parent "), "i")).otherwise(F.raise_error(F.lit("not asked for")))
    ids = spark.range(150).withColumn("i", F.col("id").cast("int")).select(F.format_string("p%02d", "i").alias("parent_id"), "i")
    parents = ids.select("parent_id", F.when(F.col("i") == 2, "-").otherwise(judged).alias("parent_text"))
    queries = spark.createDataFrame([(1, "parent 7", [1.0, 0.0])], "query_id int, query string, query_vector array<float>")
    got = retrieval.retrieve(chunks, queries, 3, reranker=models.overlap_reranker(queries, parents), parents=parents).orderBy("rank").collect()
    assert [(r.parent_id, r.chunk_id, r.rerank_score) for r in got] == [("p07", "c014", 2), ("p00", "c000", 1), ("p01", "c002", 1)]
    assert got[0].parent_text == "Un texte assez long du parent 7"
