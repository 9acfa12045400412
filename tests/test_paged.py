"""The paged source with an extractor of a made-up format: pages parted by form feeds."""

import itertools
import uuid

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking
from lexmill.sources import paged
from lexmill.sources.paged import Block, Span


class Plain:
    """Lines; ``*x*`` is bold, ``!x`` an image of these bytes, ``a;b`` a table's row; ``?`` can't be read."""

    def __init__(self, data: bytes):
        self.texts = data.decode().split("\f")

    def pages(self) -> int:
        return len(self.texts)

    def blocks(self, page: int) -> list[Block]:
        out = []
        for line in self.texts[page].split("\n"):
            if line == "?":
                raise ValueError("torn")
            if line.startswith("!"):
                out.append(Block("image", image=line[1:].encode() or None))
            elif ";" in line:
                out.append(Block("table", rows=[[c or None for c in row.split(";")] for row in line.split("/")]))
            else:
                out.append(Block("text", lines=[[Span(w, i % 2 == 1) for i, w in enumerate(line.split("*"))]]))
        return out


@pytest.fixture
def rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("Titre\nil *ne faut*** pas** \n!one\nx;y/1;\nfin\f\f!two\n!\nfoie\f?\flast", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_text("no")
    paged.register(spark, "plain_pages", Plain)
    return spark.read.format("plain_pages").option("pagesPerPartition", 2).load(f"{tmp_path}/*.pdf")


def test_rows_by_ranges_of_pages(rows):
    assert rows.rdd.getNumPartitions() == 4  # three ranges of a.pdf, and b.pdf's error
    got = sorted(((r.source, -1 if r.page is None else r.page, r.ord, r.kind, r.text, bytes(r.image) if r.image else None) for r in rows.collect()), key=str)
    a = [g[1:] for g in got if g[0] == "a.pdf"]
    assert [x for x in a if x[0] == 0] == [
        (0, 0, "marker", "<!--loc:page=1-->", None), (0, 1, "line", "Titre", None), (0, 2, "line", "il **ne faut** pas", None), (0, 3, "image", None, b"one"),
        (0, 4, "line", "fin", None), (0, 5, "table", "| x | y |\n| --- | --- |\n| 1 |  |", None),
    ]
    errors = {(r.source, r.page): r.error.partition(":")[0] for r in rows.where("kind = 'error'").collect()}
    assert errors == {("a.pdf", 3): "ValueError", ("b.pdf", None): "UnicodeDecodeError"}


def test_documents_and_images(rows, spark):
    got = {r.source: r.text for r in paged.documents(rows).collect()}
    assert got == {"a.pdf": "<!--loc:page=1-->\nTitre\nil **ne faut** pas\n[[IMG_1]]\nfin\n| x | y |\n| --- | --- |\n| 1 |  |\n\n<!--loc:page=2-->\n\n<!--loc:page=3-->\n[[IMG_2]]\n[[IMG_3]]\nfoie\n\n<!--loc:page=5-->\nlast\n"}
    assert sorted((r.image_no, r.page, bytes(r.image)) for r in paged.images(rows).collect()) == [(1, 0, b"one"), (2, 2, b"two")]
    parents = chunking.parent_chunks(paged.documents(rows).selectExpr("1L AS doc_id", "source", "text")).collect()
    assert {(p["page"], "foie" in p["parent_text"]) for p in parents} >= {(3, True), (5, False)}
    assert paged.documents(rows.where("false")).count() == 0 == paged.images(rows.where("false")).count()


def test_a_file_is_opened_for_its_bytes_not_its_pages(spark, tmp_path, monkeypatch):
    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir(), log.mkdir()
    (folder / "a.pdf").write_text("\f".join("x" * 10 for _ in range(1000)))

    class Logged(Plain):
        def __init__(self, data: bytes):
            super().__init__(data)
            (log / uuid.uuid4().hex).touch()

    paged.register(spark, "logged_pages", Logged)
    assert spark.read.format("logged_pages").load(str(folder)).where("kind = 'line'").count() == 1000
    assert len(list(log.iterdir())) == 1
    # larger files: as many ranges as their bytes need, of 64 pages at least
    for size, ranges in ((11_000, 1), (4_000, 3), (100, 16)):
        monkeypatch.setattr(paged, "RANGE_BYTES", size)
        parts = paged._Reader(str(folder), None, Plain).partitions()
        assert len(parts) == ranges and (parts[0].last is None or (parts[0].first, parts[-1].last) == (0, 1000) and all(a.last == b.first for a, b in itertools.pairwise(parts)))


def test_parts_of_a_document(spark, tmp_path):
    for name, text in (("a.2.pdf", "c\f!two\f?"), ("a.10.pdf", "d"), ("a.1.pdf", "a\f!one\nb"), ("b.1.pdf", "z")):
        (tmp_path / name).write_text(text)
    paged.register(spark, "plain_pages", Plain)
    part = lambda n: F.regexp_extract("source", r"(.)\.(\d+)\.pdf", n)
    rows = paged.joined(spark.read.format("plain_pages").load(str(tmp_path)), part(1), part(2).cast("int"))
    got = {r.source: r.text.split("\n") for r in paged.documents(rows).collect()}
    m = "<!--loc:page={}-->".format
    assert got == {"a": [m(1), "a", "", m(2), "[[IMG_1]]", "b", "", m(3), "c", "", m(4), "[[IMG_2]]", "", m(6), "d", ""], "b": [m(1), "z", ""]}
    assert [(r.source, r.page) for r in rows.where("kind = 'error'").collect()] == [("a", 4)]
