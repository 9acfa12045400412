"""Keys, waits and rates on a scripted clock."""

import json

import pytest

from lexmill.operators import keys, services


class Clock:
    def __init__(self):
        self.t, self.slept = 0.0, []

    def now(self):
        return self.t

    def sleep(self, s):
        self.slept.append(round(s, 6))
        self.t += s


def caller(script, clock, **how):
    """``script(key, call number, time)`` answers or raises."""
    asked = []

    class Service:
        def __init__(self, key):
            self.key = key

        def answer(self, prompt):
            asked.append((self.key, round(clock.t, 6)))
            clock.t += 0.5  # a call takes its time
            return script(self.key, len(asked), prompt)

    return keys.Caller(Service, ["a", "b", "c"], sleep=clock.sleep, now=clock.now, **how), asked


def refuse(*refused):
    def script(key, n, prompt):
        if key in refused or n in refused:
            raise RuntimeError("HTTP 429: slow down")
        return f"{key}{prompt}"

    return script


def test_a_refused_key_gives_way_at_once_and_stays_away():
    clock = Clock()
    c, asked = caller(refuse("a"), clock)
    assert [c.answer(str(i)) for i in range(2)] == [("b0", None, 2), ("b1", None, 1)]
    assert clock.slept == [] and [k for k, _ in asked] == ["a", "b", "b"]


def test_all_keys_refused_wait_longer_each_time_then_pass_over():
    clock = Clock()
    c, asked = caller(refuse("a", "b", "c"), clock, first=1, tries=6)
    reply, error, calls = c.answer("x")
    assert (reply, calls) == (None, 18) and "429" in error
    assert clock.slept == [15.0, 30.0, 45.0, 60.0, 60.0]
    assert [k for k, _ in asked[:4]] == ["b", "c", "a", "b"]
    c, asked = caller(refuse(1, 2, 3, 4), clock := Clock())
    assert c.answer("x") == ("bx", None, 5) and clock.slept == [15.0]


def test_other_errors_keep_the_key():
    def script(key, n, prompt):
        if n < 3:
            raise ValueError("bad gateway")
        return key

    clock = Clock()
    c, asked = caller(script, clock)
    assert c.answer("x") == ("a", None, 3) and clock.slept == [2.0, 4.0]
    c, _ = caller(lambda *a: 1 / 0, clock := Clock(), tries=2)
    assert c.answer("x") == (None, "ZeroDivisionError: division by zero", 2) and clock.slept == [2.0]
    with pytest.raises(ValueError, match="no keys"):
        keys.Caller(None, [])


def test_calls_keep_their_distance():
    clock = Clock()
    c, asked = caller(refuse(2), clock, interval=3.0)
    for i in range(3):
        c.answer(str(i))
    assert [t for _, t in asked] == [0.0, 3.0, 6.0, 9.0]  # refused calls count, too


def test_the_rate_is_shared_by_tasks(spark):
    import time

    class Service:
        def __init__(self, key):
            self.key = key

        def answer(self, prompt):
            return f"{time.time()}"

    prompts = spark.createDataFrame([(i, None if i == 3 else "p") for i in range(24)], "id int, prompt string")
    rows = keys.ask(prompts, Service, ["k"], "id", per_minute=1200, tasks=4).collect()
    times = sorted(float(r.reply) for r in rows)
    assert len(times) == 24 and all(r.calls == 1 for r in rows)
    assert times[-1] - times[0] >= 0.2 * 5 * 0.9  # six calls a task, each 4 / 20 seconds apart


def test_extraction_under_keys(spark):
    class Service:
        def __init__(self, key):
            self.key = key

        def answer(self, prompt):
            if self.key == "k1":
                raise RuntimeError("rate_limit")
            return json.dumps({"questions": [{"description": prompt[-1]}]})

    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    got = services.extract(chunks, "openai", "doc_id", "Go.", Service, wait=0.0, api_keys=["k1", "k2"]).collect()
    assert sorted((r.doc_id, r.description) for r in got) == [(1, "a"), (2, "b")]
    assert services.extract(chunks, "openai", "doc_id", "Go.", Service, wait=0.0, api_keys=["k1"]).count() == 0
