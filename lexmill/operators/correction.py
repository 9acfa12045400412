"""Structured question records: coercion, labels, alignment, attribution, catalogue and glossary."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions.text import SPACE, strip

LABEL_PREFIX = rf"\A{SPACE}*([A-Za-z]|[0-9]{{1,2}}){SPACE}*[.)\-–:]{SPACE}*"
CHOICE = "struct<label: string, letter: string, text: string, explanation: string, isCorrect: boolean>"
QUESTION = f"struct<description: string, isKtype: boolean, choices: array<{CHOICE}>, propositions: array<{CHOICE}>, correctAnswers: string, explanation: string, globalComment: string, caseDescription: string, caseIndex: int, epreuve: string>"
MIN_OVERLAP = 2


def normalize_labels(choices: Column) -> Column:
    """label (given, else the text's own, else by place) in upper case, and the text without a label in front."""

    def one(c: Column, i: Column) -> Column:
        text = strip(F.coalesce(c["text"], F.lit("")))
        own = F.nullif(F.regexp_extract(text, LABEL_PREFIX, 1), F.lit(""))
        given = F.nullif(strip(F.coalesce(F.nullif(c["label"], F.lit("")), c["letter"])), F.lit(""))
        label = F.upper(F.coalesce(given, own, F.char((i + 65).cast("bigint"))))
        return F.struct(label.alias("label"), strip(F.regexp_replace(text, LABEL_PREFIX, "")).alias("text"), F.coalesce(c["explanation"], F.lit("")).alias("explanation"), F.coalesce(c["isCorrect"], F.lit(False)).alias("is_correct"))

    return F.transform(choices, one)


def first_json(text: str | None) -> str | None:
    """The first balanced JSON array or object in a model's reply, brackets inside strings aside; null if there is none."""
    t = (text or "").strip()
    if t.startswith("```"):
        t = re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", t)).strip()
    start = re.search(r"[\[{]", t)
    if not start:
        return None
    opens, depth = start[0], 0
    closes = {"[": "]", "{": "}"}[opens]
    for token in re.finditer(r'"(?:\\.|[^"\\])*"|[\[\]{}]', t[start.start() :], re.DOTALL):
        depth += (token[0] == opens) - (token[0] == closes)
        if not depth:
            found = t[start.start() : start.start() + token.end()]
            try:
                json.loads(found)
            except ValueError:
                return None
            return found
    return None


@F.pandas_udf(StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    return replies.map(first_json)


def parse_questions(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """key, ord and the question's fields for every valid item of a reply; a single object counts as a list of one."""
    found = replies.select(key, extract_json(reply).alias("_j"))
    items = F.when(F.col("_j").startswith("["), F.from_json("_j", "array<string>")).otherwise(F.array("_j"))
    rows = found.where("_j IS NOT NULL").select(key, F.posexplode(items).alias("ord", "_t")).select(key, "ord", F.from_json("_t", QUESTION).alias("q"), F.col("_t").startswith("{").alias("_ok"))
    text = lambda name: F.coalesce(F.col(f"q.{name}"), F.lit("")).alias(name)
    empty = F.from_json(F.lit("[]"), f"array<{CHOICE}>")
    return rows.where("_ok").select(key, "ord", text("description"), F.coalesce("q.isKtype", F.lit(False)).alias("isKtype"), normalize_labels(F.coalesce("q.choices", empty)).alias("choices"), normalize_labels(F.coalesce("q.propositions", empty)).alias("propositions"), text("correctAnswers"), text("explanation"), text("globalComment"), text("caseDescription"), "q.caseIndex", text("epreuve"))


def ktype_answers(combination: Column, labels: Column) -> Column:
    """The labels that a combination ("1, 3 + 4") names."""
    named = F.filter(F.split(combination, r"[+,\-\s]+"), lambda x: x != "")
    return F.filter(labels, lambda x: F.array_contains(named, x))


def align(source: DataFrame, translated: DataFrame, key: str = "question_id") -> DataFrame:
    """Source rows (key, ord, label, text, explanation) with the translation of their label; labels stay the source's.

    A label given twice counts by its last row. ``missing``: source fields that have no translation.
    """
    lower = lambda c: F.lower(strip(c))
    last = translated.groupBy(key, lower(F.col("label")).alias("_l")).agg(F.max_by(F.struct("text", "explanation"), "ord").alias("_t"))
    rows = source.withColumn("_l", lower(F.col("label"))).join(last, [key, "_l"], "left")
    got = lambda name: strip(F.coalesce(F.col(f"_t.{name}"), F.lit("")))
    gone = lambda name: ((strip(F.coalesce(F.col(name), F.lit(""))) != "") & (got(name) == "")).cast("int")
    return rows.select(key, "ord", strip(F.col("label")).alias("label"), got("text").alias("text"), got("explanation").alias("explanation"), (gone("text") + gone("explanation")).alias("missing"))


def source_label(hits: DataFrame, group: str, order: str) -> DataFrame:
    """(group, label): documents in the order met, each with its sorted distinct pages, joined by bars."""
    doc = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))
    per = hits.groupBy(group, doc.alias("_d")).agg(F.min(order).alias("_o"), F.array_sort(F.collect_set("page")).alias("_p"))
    text = F.when(F.size("_p") > 0, F.concat("_d", F.lit(" (pages "), F.array_join(F.transform("_p", lambda p: p.cast("string")), ", "), F.lit(")"))).otherwise(F.col("_d"))
    listed = F.sort_array(F.collect_list(F.struct("_o", "_d", text.alias("t"))))
    return per.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), " | ").alias("label"))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: w != ""))


def attribute(choices: DataFrame, hits: DataFrame, group: str, least: int = MIN_OVERLAP) -> DataFrame:
    """(group, choice_id, hit_id, overlap): the snippet that shares most words with a choice's explanation.

    More than ``least`` shared words are needed, else the group's first hit stands in; an empty explanation has none; ties
    to the earlier hit. The join is inside a group: a question's choices against its own few hits.
    """
    left = choices.where(strip(F.coalesce("explanation", F.lit(""))) != "").select(group, "choice_id", words(F.col("explanation")).alias("_w"))
    right = hits.select(group, "hit_id", F.col("ord").alias("_o"), words(F.col("snippet")).alias("_s"))
    scored = left.join(right, group).withColumn("overlap", F.size(F.array_intersect("_w", "_s")))
    best = F.row_number().over(Window.partitionBy(group, "choice_id").orderBy(F.desc(F.when(F.col("overlap") > least, F.col("overlap")).otherwise(0)), "_o"))
    return scored.withColumn("_r", best).where("_r = 1").select(group, "choice_id", "hit_id", "overlap")


def with_catalogue(suggestions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Suggested ids checked against the catalogue: an unknown id is null, the name is always the catalogue's."""
    known = catalogue.select(F.col("id").cast("string").alias("_id"), F.col("name").alias("_name"))
    out = suggestions.join(known, F.col("suggested_id").cast("string") == F.col("_id"), "left")
    return out.withColumn("suggested_id", F.col("_id")).withColumn("suggested_name", F.col("_name")).drop("_id", "_name")


def by_position(questions: DataFrame, suggestions: DataFrame, group: str) -> DataFrame:
    """Suggestions in the order given, one for each question in its order; questions without one keep nulls."""
    at = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("ord")))
    return at(questions).join(at(suggestions).drop("ord"), [group, "_n"], "left").drop("_n")


def glossary_lines(glossary: DataFrame, group: str, order: str) -> DataFrame:
    """(group, block): a line for each complete pair, its sense or note in brackets."""
    hint = F.coalesce(F.nullif("sense", F.lit("")), F.nullif("note", F.lit("")))
    line = F.concat(F.lit("- « "), F.col("termFr"), F.lit(" » → « "), F.col("termEn"), F.lit(" »"), F.coalesce(F.concat(F.lit("  ("), hint, F.lit(")")), F.lit("")))
    whole = glossary.where("coalesce(termFr, '') <> '' AND coalesce(termEn, '') <> ''")
    return whole.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n").alias("block"))


def contents(history: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """(group, turns): role and text in order; every role but user is the model's."""
    turn = F.struct(F.col(order).alias("o"), F.when(F.col("role") == "user", "user").otherwise("model").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return history.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def listing(items: DataFrame, group: str, order: str, text: Column) -> DataFrame:
    """(group, listing): lines in order, as a prompt lists a catalogue or questions."""
    return items.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), "\n").alias("listing"))


def prompt_context(chunk: Column, dynamic: Column) -> Column:
    return F.coalesce(F.nullif(chunk, F.lit("")), F.nullif(dynamic, F.lit("")), F.lit(""))
