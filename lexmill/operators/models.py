"""Edges to models: interfaces, a batched runner with retries, and deterministic offline stand-ins.

Stand-ins are for tests and dry runs; what they answer is never a model's answer.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.config import Options
from lexmill.operators.correction import words


class Model(Protocol):
    """Answers a prompt; raises on failure. ``transient`` says whether a failure may pass by itself."""

    def answer(self, prompt: str) -> str: ...

    def transient(self, error: Exception) -> bool: ...


class Scripted:
    """A stand-in that answers with a function of the prompt."""

    def __init__(self, reply: Callable[[str], str]):
        self.reply = reply

    def answer(self, prompt: str) -> str:
        return self.reply(prompt)

    def transient(self, error: Exception) -> bool:
        return False


def empty_extraction(prompt: str) -> str:
    return json.dumps({"questions": [], "clinical_cases": []})


#: Offline stand-ins by provider; a deployment registers its own factories.
PROVIDERS: dict[str, Callable[[], Model]] = {name: lambda: Scripted(empty_extraction) for name in ("gemini", "openai", "groq", "anthropic")}


def provider(name: str) -> Model:
    try:
        return PROVIDERS[name.lower()]()
    except KeyError:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(PROVIDERS)}") from None


def ask(prompts: DataFrame, make: Callable[[], Model], key: str, prompt: str = "prompt", tries: int | None = None, wait: float = 1.0, on_failure: str = "skip", every: bool = False) -> DataFrame:
    """key, reply, error of every prompt. Transient failures (``every``: all) are tried again with growing waits.

    on_failure: 'skip' leaves a null reply and the error, 'raise' fails the task, 'settle' fails it unless the last
    failure is transient. Join answered prompts away first
    (``store.cached``): a task that Spark repeats asks again. The session's option says how often to try unless given.
    """
    tries = Options.of(prompts.sparkSession).model_tries if tries is None else tries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf[prompt], strict=True):
                reply = error = None
                for n in range(tries):
                    try:
                        reply, error = model.answer(text), None
                        break
                    except Exception as exc:  # noqa: BLE001 - the policy below decides
                        error = f"{type(exc).__name__}: {exc}"
                        passing = model.transient(exc)
                        if n == tries - 1 or not (every or passing):
                            if on_failure == "raise" or on_failure == "settle" and not passing:
                                raise
                            break
                        time.sleep(wait * 2**n * (0.5 + random.random()))
                rows.append((k, reply, error))
            yield pd.DataFrame(rows, columns=[key, "reply", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, error string")


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], key: str, text: str = "text", batch: int | None = None, tries: int | None = None, wait: float = 1.0, transient: Callable[[Exception], bool] = lambda error: False) -> DataFrame:
    """key, vector: texts in batches of ``batch``, a batch that fails in passing tried again with growing waits.

    A call that answers with fewer vectors than texts fails the task. ``make`` gives the call for documents or for
    queries, whichever the texts are. Batch size and tries are the session's options unless given.
    """
    options = Options.of(texts.sparkSession)
    batch, tries = options.embed_batch if batch is None else batch, options.model_tries if tries is None else tries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for n in range(tries):
                    try:
                        vectors = call(part[text].tolist())
                        break
                    except Exception as exc:  # noqa: BLE001 - ``transient`` decides
                        if n == tries - 1 or not transient(exc):
                            raise
                        time.sleep(wait * 2**n)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(vectors)} vectors")
                yield pd.DataFrame({key: part[key], "vector": vectors})

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, vector array<float>")


def overlap_reranker(queries: DataFrame, parents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A stand-in reranker: shared words of the query and the parent's text."""

    def rerank(candidates: DataFrame) -> DataFrame:
        joined = candidates.join(queries.select("query_id", "query"), "query_id")
        if "parent_text" not in candidates.columns:
            joined = joined.join(parents.select("parent_id", "parent_text"), "parent_id")
        return joined.withColumn("rerank_score", F.size(F.array_intersect(words(F.col("query")), words(F.col("parent_text"))))).drop("query")

    return rerank


def nearest_entry(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """question_id, suggested_id: the catalogue entry that shares most words; null if none does. A baseline classifier.

    The catalogue is exploded by word and joined on words, so a question meets only entries it shares a word with.
    """
    asked = questions.select("question_id", F.explode(words(F.col("text"))).alias("w"))
    known = catalogue.select(F.col("id").cast("string").alias("suggested_id"), F.explode(words(F.col("name"))).alias("w"))
    shared = asked.join(known, "w").groupBy("question_id", "suggested_id").agg(F.count("*").alias("n"))
    best = shared.groupBy("question_id").agg(F.max_by("suggested_id", F.struct(F.col("n"), F.col("suggested_id"))).alias("suggested_id"))
    return questions.select("question_id").join(best, "question_id", "left")
