"""Steps around outside services as relations: what is asked, what came back, and what is done where it failed.

A service itself is a ``Model`` or a function given by the deployment; nothing here calls the network.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators import correction, keys, models

# The states in which a batch job has ended, well or badly.
ENDED_WELL = ("SUCCESS",)
ENDED_BADLY = ("FAILED", "CANCELLED", "CANCELLATION_REQUESTED", "TIMEOUT_EXCEEDED")
#: Tries of a provider, and what is done when they are used up ('settle': a lasting error fails the task, a passing one skips).
POLICIES = {"gemini": (4, "skip"), "openai": (5, "settle"), "groq": (5, "settle"), "anthropic": (3, "settle")}
NO_ANSWER = "No response generated"


# ── batch jobs ──


def ended(status: Column) -> tuple[Column, Column]:
    """(done, ok) of a job's state."""
    return status.isin(*ENDED_WELL, *ENDED_BADLY), status.isin(*ENDED_WELL)


def request_lines(files: DataFrame, url: str = "url") -> DataFrame:
    """custom_id, line: one JSON request for each document; ``files``: custom_id, url, pages (null or empty: all)."""
    document = F.struct(F.lit("document_url").alias("type"), F.col(url).alias("document_url"))
    pages = F.when(F.size("pages") > 0, F.col("pages"))
    body = F.struct(document.alias("document"), pages.alias("pages"))
    return files.select("custom_id", F.to_json(F.struct("custom_id", body.alias("body"))).alias("line"))


def removable(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """job_id, file: a job's uploads that may go, once it ended well and its result is in ``stored`` (job_id)."""
    gone = jobs.where(ended(F.col("status"))[1]).join(stored.select("job_id").distinct(), "job_id", "left_semi")
    return gone.select("job_id", F.explode(F.array("file_id", "batch_file_id")).alias("file")).where("file <> ''")


def contract(raw: DataFrame, key: str, column: str = "raw") -> DataFrame:
    """key, page_keys, types, lists of each response: its first page's fields, all pages' block types, and the fields that are lists."""
    pages = F.from_json(F.get_json_object(column, "$.pages"), "array<string>")
    fields = lambda p: F.from_json(p, "map<string,string>")
    kinds = F.flatten(F.transform("_p", lambda p: F.coalesce(F.from_json(p, "blocks array<struct<type: string>>")["blocks"]["type"], F.array().cast("array<string>"))))
    lists = F.map_keys(F.map_filter(fields(F.get("_p", F.lit(0))), lambda k, v: v.startswith("[") & F.from_json(v, "array<string>").isNotNull()))
    rows = raw.select(key, pages.alias("_p"))
    return rows.select(key, F.array_sort(F.map_keys(fields(F.get("_p", F.lit(0))))).alias("page_keys"), F.array_sort(F.array_distinct(F.array_compact(kinds))).alias("types"), F.array_sort(lists).alias("lists"))


# ── models ──


def usable_models(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """key, model: those of a listing that generate content, without the name's prefix; a reply that isn't a listing gives none."""
    listing = F.from_json(reply, "models array<struct<name: string, supportedGenerationMethods: array<string>>>")["models"]
    rows = replies.select(key, F.explode(listing).alias("m")).where(F.array_contains("m.supportedGenerationMethods", "generateContent"))
    return rows.select(key, F.replace(F.col("m.name"), F.lit("models/"), F.lit("")).alias("model"))


def thinking_budget(model: Column) -> Column:
    """Tokens a model may think with; null for one that has no such setting."""
    return F.when(model.contains("2.5") | model.contains("latest"), F.when(model.contains("pro"), 128).otherwise(0))


def starts_case(reply: Column, remembered: Column) -> Column:
    """Whether a classifier says that a message starts a case; without an answer it does if nothing is remembered."""
    says = F.upper(reply)
    return F.when(reply.isNull(), F.coalesce(remembered, F.lit("")) == "").otherwise(says.contains("NEW") & ~says.contains("CONTINU"))


def extract(chunks: DataFrame, provider: str, key: str, instruction: str = "", make: Callable[..., models.Model] | None = None, wait: float = 1.0, api_keys: Sequence[str] = (), per_minute: float | None = None) -> DataFrame:
    """key, ord and the fields of every question a provider finds in ``chunks`` (key, text), by its policy of tries and failures.

    With ``api_keys``, ``make`` takes one of them; a key that is refused for its rate gives way to the next, and the tasks
    share ``per_minute`` calls. A chunk for which all are spent is passed over.
    """
    if provider.lower() not in POLICIES:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(POLICIES)}")
    tries, policy = POLICIES[provider.lower()]
    prompts = chunks.select(key, F.concat(F.lit(instruction), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
    if api_keys:
        answered = keys.ask(prompts, make or (lambda _: models.provider(provider)), api_keys, key, tries=tries, per_minute=per_minute, wait=wait)
    else:
        answered = models.ask(prompts, make or (lambda: models.provider(provider)), key, tries=tries, wait=wait, on_failure=policy, every=True)
    return correction.parse_questions(answered.select(key, F.get_json_object("reply", "$.questions").alias("reply")), key, "reply")


def researched(rows: DataFrame, research: Callable[[], models.Model], structure: Callable[[], models.Model], key: str, wait: float = 1.0) -> DataFrame:
    """key, structured, reply: research on a prompt as free text, then its structure.

    ``rows``: key, prompt. Each pass has one retry. reply is empty where the structure holds a question, else what the
    research found. Without a research answer, the structure is asked for from the prompt alone.
    """
    found = models.ask(rows, research, key, tries=2, wait=wait, every=True).select(key, F.col("reply").alias("_found"))
    asked = rows.join(found, key).select(key, "_found", F.concat_ws("\n\n", "prompt", "_found").alias("prompt"))
    shaped = models.ask(asked, structure, key, tries=2, wait=wait, every=True).select(key, F.col("reply").alias("structured"))
    good = correction.parse_questions(shaped, key, "structured").select(key).distinct().withColumn("_good", F.lit(True))
    out = asked.select(key, "_found").join(shaped, key).join(good, key, "left")
    return out.select(key, F.when(F.col("_good"), F.col("structured")).alias("structured"), F.when(F.col("_good"), "").otherwise(F.coalesce(F.nullif("_found", F.lit("")), F.lit(NO_ANSWER))).alias("reply"))


def translated(source: DataFrame, translate: Callable[[DataFrame, int], DataFrame], key: str = "question_id") -> DataFrame:
    """``correction.align``'s rows and error: questions with fields missing are translated once more; what is missing then is an error.

    ``translate`` takes source rows and the number of the try (0, 1) and gives rows of key, ord, label, text, explanation.
    """
    first = correction.align(source, translate(source, 0), key)
    short = first.where("missing > 0").select(key).distinct()
    again = source.join(short, key, "left_semi")
    rows = first.join(short, key, "left_anti").unionByName(correction.align(again, translate(again, 1), key))
    left = rows.groupBy(key).agg(F.sum("missing").alias("_left"))
    return rows.join(left, key).withColumn("error", F.when(F.col("_left") > 0, F.concat(F.col("_left"), F.lit(" fields missing")))).drop("_left")


def reranked(candidates: DataFrame, answers: DataFrame, top_k: int) -> DataFrame:
    """``candidates`` (query_id, position from 0 in dense order) in a reranker's order, with rerank_score and rank (from 1).

    ``answers``: query_id, ord, index, score as the service gave them. An index that isn't a candidate's position is
    passed over; where none is left (failure, empty answer) or there is but one candidate, the first ``top_k`` stay in
    dense order.
    """
    pool = candidates.groupBy("query_id").agg(F.count("*").alias("_n")).where("_n > 1")
    valid = answers.join(pool, "query_id").where((F.col("index") >= 0) & (F.col("index") < F.col("_n")))
    valid = valid.select("query_id", F.col("index").alias("position"), F.col("ord").alias("_ord"), F.col("score").cast("double").alias("rerank_score"))
    dense = candidates.join(valid.select("query_id").distinct(), "query_id", "left_anti").where(F.col("position") < top_k)
    both = candidates.join(valid, ["query_id", "position"]).unionByName(dense.withColumn("_ord", F.col("position")), allowMissingColumns=True)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_ord", "position"))).drop("_ord")


# ── sinks ──


def outcomes(results: DataFrame, failures: DataFrame) -> DataFrame:
    """job_id, ok, body: what is reported of each job; ``results``: job_id and columns of the body, ``failures``: job_id, kind, message."""
    done = F.to_json(F.struct(F.col("job_id").alias("jobId"), *[F.col(f"`{c}`") for c in results.columns if c != "job_id"]))
    bad = F.to_json(F.struct(F.col("job_id").alias("jobId"), F.concat("kind", F.lit(": "), "message").alias("error")))
    return results.select("job_id", F.lit(True).alias("ok"), done.alias("body")).unionByName(failures.select("job_id", F.lit(False).alias("ok"), bad.alias("body")))


def delivered(rows: DataFrame, path: str, partition: str | None = None) -> str | None:
    """Writes rows to a sink that must not fail the job: None, or what went wrong. A partition's new rows replace its old."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    try:
        (writer.partitionBy(partition) if partition else writer).parquet(path)
    except (PySparkException, Py4JError) as error:
        return f"{type(error).__name__}: {error}"
    return None


def image_urls(images: DataFrame, base: str, folder: str = "images") -> DataFrame:
    """key, path, url of every image (key, content): folder, key and the extension that its first bytes tell."""
    from lexmill.operators.store import image_type

    path = F.concat(F.lit(f"{folder}/"), "key", F.lit("."), image_type(F.col("content")))
    return images.select("key", path.alias("path"), F.concat(F.lit(base.rstrip("/") + "/"), path).alias("url"))
