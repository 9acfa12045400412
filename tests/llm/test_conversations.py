import hashlib
import heapq
import random
import re

import duckdb
import pandas as pd
import pytest

from lexmill.llm import conversations as C

KINDS = [(i, f, t) for i in "suax" for f in ("", "truncated", "blank", "duplicate") for t in (1, 1, 2)]


def all_edits(rows):
    """Every state's edits tried one by one, in order of (cost, letters): the first that ends well."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, letters
        if len(roles) < 9 and letters[-3:] != "III":
            for role in "ua":
                heapq.heappush(heap, (cost + 3, letters + "I", i, roles + role))
        if i < len(rows):
            initial, fault, times = rows[i]
            gone = "D" * (times - 1)
            heapq.heappush(heap, (cost + 4 * times, letters + "D" + gone, i + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 4 * (times - 1) + 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, letters + "K" + gone, i + 1, roles + initial))
                for role in "ua":
                    heapq.heappush(heap, (cost + 3 + more, letters + "R" + gone, i + 1, roles + role))


def test_walk_takes_the_least_audit_of_all_edits():
    rng = random.Random(11)
    for _ in range(150):
        rows = [rng.choice(KINDS) for _ in range(rng.randint(0, 4))]
        costs = C.costs_to_go(rows, C.ENDS)
        audit = "".join(letters for letters, _, _ in C.walk(rows, costs, C.START, True))
        assert (costs[0][C.START], audit) == all_edits(rows), rows


def oracle(pdf):
    con = duckdb.connect()
    con.register("conversations", pdf)
    return con.sql(C.ORACLE).df()


def same(out, want):
    sort = lambda x: x[want.columns].sort_values("conv_id", na_position="first").reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(out), sort(want), check_dtype=False)


SCHEMA = "conv_id long, turn long, role string, text string, part int, conv string, fault string, _doc string"


def turns(rng, n, ids, last):
    say = ["Yes.", "No.", "Why?", "never ends", "Done! ", "", " \n", None, "é.", "two\nlines."]
    return [(rng.choice(ids), rng.choice([None, *range(last)]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(say) if rng.random() < 0.4 else f"Say {rng.randint(0, 999)}{rng.choice('.,')}", 7, "x", "y", "z") for _ in range(n)]


@pytest.mark.parametrize("part_rows", [3, 40, 10_000])
def test_long_conversations_in_segments_equal_sql(spark, part_rows):
    rng = random.Random(part_rows)
    rows = turns(rng, 90, [5], 60) + turns(rng, 60, [None, 1, 2], 20) + turns(rng, 30, range(10, 24), 6)
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.repair_conversations(C.damaged(df), part_rows).drop("conv").toPandas()
    want = oracle(df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    some = want.merge(out[["conv_id"]], on="conv_id")  # without those that lost all their rows
    same(out, some)
    same(C.repaired_damage(df).toPandas(), want)


def test_pieces_are_joined(monkeypatch):
    n = 40
    rows = pd.DataFrame({"part": [0] * n, "conv": ["1"] * n, "initial": list("ua") * (n // 2), "fault": [""] * n, "times": [1] * n, "role": ["user", "assistant"] * (n // 2), "text": [f"{t}." for t in range(n)], "to_go": [list(C.ENDS)] * n, "last": [True] * n, "entry": [C.START] * n})
    monkeypatch.setattr(C, "PIECE_CHARS", 30)
    pieces = pd.concat(C._repair(iter([rows[:7], rows[7:]])))
    assert len(pieces) > 5
    joined = pd.concat(C._joined(iter([pieces[:2], pieces[2:]])))
    text = "\n".join(f"{r}:{t}" for r, t in zip(rows["role"], rows["text"], strict=True))
    assert joined.values.tolist() == [["1", 0, 0, "K" * n, hashlib.sha256(text.encode()).hexdigest()]]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_conversations(empty).count() == 0
    assert C.repaired_damage(empty).count() == 0
    lost = spark.createDataFrame([(None, None, None, None)] * 3, "conv_id long, turn long, role string, text string")
    assert [tuple(r)[1:6] for r in C.repair_conversations(lost).select("conv", "gaps", "blank", "duplicate", "truncated", "cost").collect()] == [(0, 3, 0, 0, 12)]
