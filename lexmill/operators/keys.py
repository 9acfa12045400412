"""Calls to a service under several keys and a rate that the whole cluster shares."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.models import Model

#: What an error says when its key has no calls left.
LIMITED = ("429", "rate_limit", "too many requests", "organization_restricted")
#: Seconds by which the wait grows each time all keys are spent, and its bound.
STEP_S, MOST_S = 15.0, 60.0


def limited(error: Exception) -> bool:
    return any(sign in str(error).lower() for sign in LIMITED)


class Caller:
    """One task's calls: a key is used until it is refused for its rate, then the next takes over at once.

    When all keys were refused in a row it waits, longer each time; another error waits 2, 4, 8.. steps. Calls begin
    ``interval`` seconds apart at least.
    """

    def __init__(self, make: Callable[[str], Model], keys: Sequence[str], first: int = 0, tries: int = 4, interval: float = 0.0, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        if not keys:
            raise ValueError("no keys")
        self.make, self.keys, self.at, self.tries, self.interval, self.wait, self.sleep, self.now = make, list(keys), first % len(keys), tries, interval, wait, sleep, now
        self.models: dict[int, Model] = {}
        self.begun: float | None = None

    def _model(self) -> Model:
        if self.at not in self.models:
            self.models[self.at] = self.make(self.keys[self.at])
        return self.models[self.at]

    def _pace(self) -> None:
        if self.begun is not None and (left := self.begun + self.interval - self.now()) > 0:
            self.sleep(left)
        self.begun = self.now()

    def answer(self, prompt: str) -> tuple[str | None, str | None, int]:
        """reply, error, calls. After ``tries`` rounds of all keys, or failures, the error stays and the prompt is passed over."""
        tried = calls = refused = 0
        while True:
            self._pace()
            calls += 1
            try:
                return self._model().answer(prompt), None, calls
            except Exception as error:  # noqa: BLE001 - the policy decides
                said = f"{type(error).__name__}: {error}"
                if limited(error):
                    self.at, refused = (self.at + 1) % len(self.keys), refused + 1
                    if refused % len(self.keys):
                        continue
                    tried += 1
                    pause = min(STEP_S * tried, MOST_S)
                else:
                    tried += 1
                    pause = 2.0**tried
                if tried >= self.tries:
                    return None, said, calls
                self.sleep(self.wait * pause)


def ask(prompts: DataFrame, make: Callable[[str], Model], keys: Sequence[str], key: str, prompt: str = "prompt", tries: int = 4, per_minute: float | None = None, tasks: int | None = None, wait: float = 1.0) -> DataFrame:
    """key, reply, error, calls of every prompt, asked under ``keys`` at no more than ``per_minute`` calls in all.

    The prompts are dealt to ``tasks`` (the cores by default), each with its share of the rate and another key to begin
    with; so the rate holds however many tasks run at once, without a word between them. A null prompt is asked as an empty
    one; an empty table gives no rows. Join answered prompts away first: a task that Spark repeats asks again.
    """
    tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    interval = 60.0 * tasks / per_minute if per_minute else 0.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        caller = Caller(make, keys, context.partitionId() if context else 0, tries, interval, wait)
        for pdf in frames:
            yield pd.DataFrame([(k, *caller.answer(p if isinstance(p, str) else "")) for k, p in zip(pdf["key"].tolist(), pdf["prompt"].tolist(), strict=True)], columns=[key, "reply", "error", "calls"])

    kind = prompts.schema[key].dataType.simpleString()
    dealt = prompts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{prompt}`").cast("string").alias("prompt")).repartition(tasks)
    return dealt.mapInPandas(run, f"`{key}` {kind}, reply string, error string, calls int")
