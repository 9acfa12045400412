"""Batch result files in splits, Word runs."""

import json
import random

from pyspark.sql import functions as F

from lexmill.operators import ocr
from lexmill.sources import docx, files


def test_ordinals_across_splits(spark, tmp_path):
    rnd = random.Random(3)
    want = {}
    for name in ("a", "b", "c"):
        lines = [rnd.choice(["", "  ", json.dumps({"id": n, "pad": "é" * rnd.randint(0, 90)})]) for n in range(rnd.randint(1, 200))]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name == "b" else ""), encoding="utf-8")
        want |= {(f"{name}.jsonl", n): x for n, x in enumerate(lines) if x.strip()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = files.result_lines(spark, str(tmp_path))
        rows = lines.collect()
        assert spark.read.text(str(tmp_path)).select(F.countDistinct(F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")))).first()[0] > 9
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert {(r.file.rpartition("/")[2], r.ordinal): r.value for r in rows} == want


def test_first_result_of_each_file(spark):
    body = lambda x: json.dumps({"response": {"body": x}})
    rows = [("a", 0, ""), ("a", 1, "  "), ("a", 2, body({})), ("a", 3, body({"pages": []})), ("a", 4, '{"pages": [1]}'), ("b", 7, '{"pages": [1]}'), ("b", 6, '{"pages": []}'), ("b", 9, body({"x": 1})), ("c", 0, body(None)), ("c", 1, "{}"), ("d", 0, "not json")]
    got = {r.file: (r.ordinal, r.raw) for r in ocr.first_result(spark.createDataFrame(rows, "file string, ordinal long, value string")).collect()}
    assert got == {"a": (3, '{"pages":[]}'), "b": (7, '{"pages": [1]}')}


def test_neighbouring_bold_runs_are_joined_by_a_space():
    from xml.etree import ElementTree

    run = lambda text, bold: f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{text}</w:t></w:r>"
    said = lambda *runs: docx.rich_text(ElementTree.fromstring(f'<w:p xmlns:w="{docx.W[1:-1]}">{"".join(run(*r) for r in runs)}</w:p>'))
    assert said(("a", True), ("b", True)) == "**a b**"
    assert said(("a ", True), ("b", True)) == "**a b**"
    assert said(("a", True), (" ", False), ("b", True), ("c", False)) == "**a b**c"
