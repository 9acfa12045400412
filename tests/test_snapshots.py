"""Changes of the chunk table: counts, spellings, readers during changes, changes that are cut short or come second."""

import pytest

from lexmill.operators import snapshots
from lexmill.operators.snapshots import ChunkTable

KIND = "chunk_id long, source string, module string, file_url string, `a.b` string"
ROWS = [(1, "a.pdf", "m", None, "x"), (2, "A.PDF", "m", None, "x"), (3, "b.pdf", "Cardio", None, "x"), (4, None, "cardio", None, "x"), (5, "", None, "u", None), (6, "c.pdf", "n", "u", "x")]


def rows_of(table, version=None):
    return list(map(tuple, table.read(version).collect()))


def test_changes(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        table.read()
    first = spark.createDataFrame(ROWS, KIND)
    table.create(first.schema, buckets=4)
    table.create(first.schema)
    assert rows_of(table) == [] and table.snapshot()["buckets"] == 4
    assert table.replace_sources(first) == (0, 6)
    held = table.read()
    assert table.replace_sources(spark.createDataFrame([(7, "a.pdf", "m2")], "chunk_id long, source string, module string")) == (2, 1)
    assert set(rows_of(table)) == {*ROWS[2:], (7, "a.pdf", "m2", None, None)}
    assert set(map(tuple, held.collect())) == set(ROWS)  # a reader goes on with what it has opened
    assert table.delete({"module": "cardio"}) == 2
    assert table.delete({"module": "cardio"}) == 0 == table.delete({"module": ""}) == table.delete({"source": "none"})
    assert table.retag("B.pdf", "v") == 0 and table.retag("C.pdf", "v") == 1  # that one's spellings: C.pdf, C.PDF, c.pdf
    assert set(rows_of(table)) == {ROWS[4], (6, "c.pdf", "n", "v", "x"), (7, "a.pdf", "m2", None, None)}


def test_retag_and_old_snapshots(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"))
    first = spark.createDataFrame(ROWS, KIND)
    table.create(first.schema, buckets=8)
    table.replace_sources(first)
    assert table.retag("a.pdf", "v") == 2
    assert {r.file_url for r in table.read().where("lower(source) = 'a.pdf'").collect()} == {"v"}
    assert table.versions() == [0, 1, 2] and set(rows_of(table, 1)) == set(ROWS) and table.read(2).where("file_url = 'v'").count() == 2
    assert table.vacuum(keep=1) >= 1 and table.versions() == [2] and table.read().count() == 6
    assert table.vacuum(keep=1) == 0


def test_a_failed_change_and_a_second_one_leave_the_table(spark, tmp_path, monkeypatch):
    table = ChunkTable(spark, str(tmp_path / "t"))
    first = spark.createDataFrame(ROWS, KIND)
    table.create(first.schema)
    table.replace_sources(first)
    bad = spark.createDataFrame([(9, "a.pdf", "m")], "chunk_id long, source string, module string").selectExpr("chunk_id", "source", "raise_error('lost') AS module")
    with pytest.raises(Exception, match="lost"):
        table.replace_sources(bad)
    assert set(rows_of(table)) == set(ROWS)
    old = table.snapshot()
    other = ChunkTable(spark, str(tmp_path / "t"))
    assert other.delete({"source": "b.pdf"}) == 1
    monkeypatch.setattr(table, "snapshot", lambda version=None: old)
    with pytest.raises(snapshots.ConcurrentChange):
        table.delete({"source": "c.pdf"})
    assert set(rows_of(other)) == {r for r in ROWS if r[0] != 3}
