"""Case memory over several batches of a file stream, restarts included, against one fold."""

import random

from lexmill.streaming import ingest


def fold(rows):
    out, memory = {}, {}
    for conv, turn, text in sorted(rows, key=lambda r: r[1]):
        new, memory[conv] = ingest.remember(text or "", memory.get(conv, ""))
        out[conv, turn] = (new, memory[conv])
    return out


def test_batches_equal_one_fold(spark, tmp_path):
    rnd = random.Random(4)
    says = ["Cas clinique 1 : un patient\n1. Que faire ?", "Patiente de 30 ans", "3. Suite ?", "Et ensuite\n2. Dose ?", None, "", "Évolution favorable\n4) Pronostic ?"]
    rows = [(conv, turn, rnd.choice(says)) for conv in range(12) for turn in range(rnd.randint(1, 10))]
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    kind = "conv_id long, turn long, text string"
    for part in range(3):
        some = [r for r in rows if r[1] // 4 == part]
        spark.createDataFrame(some, kind).repartition(3, "conv_id").write.mode("append").parquet(source)
        if part != 1:  # the second part is read by the third start, in a batch of its own
            query = ingest.case_stream(spark, source, target, state, files=3)
            query.awaitTermination()
    got = spark.read.parquet(target).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r.is_new, r.context) for r in got} == fold(rows)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 2


def test_states_can_be_forgotten(spark, tmp_path):
    spark.createDataFrame([(1, 0, "Cas clinique : a")], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.case_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ttl_ms=1).awaitTermination(60)
    run()
    spark.createDataFrame([(1, 1, "2. Suite ?")], "conv_id long, turn long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.turn: r.is_new for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: True, 1: True}
