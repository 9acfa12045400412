import json

import pytest

from lexmill.operators import models, services


class Failing:
    def __init__(self, passing):
        self.passing = passing

    def answer(self, prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return json.dumps({"questions": [{"description": prompt[-1]}]})

    def transient(self, error):
        return self.passing


def test_policies(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, text string")
    for name, passing in (("gemini", False), ("openai", True)):
        got = services.extract(chunks, name, "id", make=lambda passing=passing: Failing(passing), wait=0).collect()
        assert sorted((r.id, r.description) for r in got) == [(1, "a"), (3, "\n")]
    with pytest.raises(Exception, match="no"):
        services.extract(chunks, "anthropic", "id", make=lambda: Failing(False), wait=0).collect()
    with pytest.raises(ValueError, match="unknown provider"):
        services.extract(chunks, "else", "id")


def test_research_then_structure(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, prompt string")
    research = lambda: models.Scripted(lambda p: "" if p == "c" else "found " + p)
    structure = lambda: models.Scripted(lambda p: '[{"description": "q"}]' if "found a" in p else "none")
    got = sorted(map(tuple, services.researched(rows, research, structure, "id", wait=0).collect()))
    assert got == [(1, '[{"description": "q"}]', ""), (2, None, "found b"), (3, None, services.NO_ANSWER)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sha256 string, raw int")
    path = str(tmp_path / "cache")
    assert services.delivered(rows, path, "sha256") is None
    assert services.delivered(rows.where("sha256 = 'a'").selectExpr("sha256", "raw + 9 AS raw"), path, "sha256") is None
    assert sorted((r.sha256, r.raw) for r in spark.read.parquet(path).collect()) == [("a", 10), ("b", 2)]
    (tmp_path / "file").write_text("x")
    assert services.delivered(rows, str(tmp_path / "file" / "under"))
    images = spark.createDataFrame([("k", bytearray(b"\xff\xd8\xff0")), ("l", bytearray(b"?"))], "key string, content binary")
    assert [r.url for r in services.image_urls(images, "http://x/", "f").orderBy("key").collect()] == ["http://x/f/k.jpg", "http://x/f/l.png"]
    line = services.request_lines(spark.createDataFrame([("c", "u", [1])], "custom_id string, url string, pages array<int>")).first().line
    assert json.loads(line) == {"custom_id": "c", "body": {"document": {"type": "document_url", "document_url": "u"}, "pages": [1]}}
