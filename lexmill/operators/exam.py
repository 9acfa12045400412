"""Exam documents: question boundaries, chunks with carried context, question splits, case folds, grouping."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexmill.functions.text import let, strip

CHUNK_CHARS, MAX_QUESTIONS = 2000, 8
LINES = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# The marks of questions, headings, cases, options and stop sections.
NUMBERED = r"^(\*\*|\*)?\d+\s*[\.\)\-:]\s"
PLAIN_NUMBERED = r"^\d+\s*[\.\)\-:]\s"
QUESTION_N = r"(?iu)^(\*\*|\*)?Question\s+\d+"
MD_HEADING = r"^#{1,3}\s"
CASE = r"(?iu)^(\*\*|\*)?Cas\s+[Cc]linique"
STOPS = r"(?iu)(\bQCS\b|\bQCM\b|Questions?\s+isol[eé]es?|Questions?\s+ind[eé]pendantes?|Questions?\s+à\s+choix\s+simples?|Questions?\s+à\s+choix\s+multiples?)"
CASE_HEADER = r"(?iu)\A\s*(cas\s+clinique|observation\s+clinique|cas\s+n[°o]|(?:une?\s+)?patient[e]?\b)"
FIRST_QUESTION = r"(?m)^\s*(\d{1,2})\s*[.)]\s"
CUE = r"(?iu)\?|\b(quelles?|quels?|parmi|cochez|indiquez|citez|donnez|pr[ée]cisez|concernant|laquelle|lequel|lesquell?es?|d[ée]finir|d[ée]finissez)\b"
OPTION = r"^\s*(?:[A-Za-z]|\d{1,2})\s*[.)\-–:]\s+\S"
LETTER = r"^\s*[A-Za-z]\s*[.)\-–:]\s+\S"
NUMBER = r"^\s*\d{1,2}\s*[.)]\s+"


def question_boundaries(text: Column) -> Column:
    """Character offsets at which a question, heading or case line begins; 0 first.

    A plain number counts only at the start or after a blank line, so that sub-propositions don't split a question.
    """

    def marked(line: Column, before: Column) -> Column:
        mark = line.rlike(NUMBERED) | line.rlike(QUESTION_N) | line.rlike(MD_HEADING) | line.rlike(CASE)
        return mark & ~(line.rlike(PLAIN_NUMBERED) & before.isNotNull() & (strip(F.coalesce(before, F.lit(""))) != ""))

    def offsets(lines: Column) -> Column:
        zero = F.from_json(F.lit('{"at": 0, "out": [0]}'), "struct<at: int, before: string, out: array<int>>")
        step = lambda a, x: F.struct((a["at"] + F.length(x) + 1).cast("int").alias("at"), x.alias("before"), F.when((a["at"] > 0) & marked(strip(x), a["before"]), F.concat(a["out"], F.array(a["at"]))).otherwise(a["out"]).alias("out"))
        return F.aggregate(lines, zero, step, lambda a: a["out"])

    return let(F.split(text, "\n", -1), offsets)


def exam_cuts(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Texts of the chunks: each ends at the last boundary that fits, else at the next one, so no question is cut."""

    def cut(t: Column) -> Column:
        n = F.length(t)
        zero = F.from_json(F.lit('{"start": 0, "last": 0, "cuts": [0]}'), "struct<start: int, last: int, cuts: array<int>>")

        def settle(start: Column, last: Column, cuts: Column, b: Column) -> Column:
            """b against a start with no boundary behind that is still open."""
            beyond = (start + most < n) & (b > start + most)
            return F.struct(F.when(beyond, b).otherwise(start).alias("start"), b.alias("last"), F.when(beyond, F.concat(cuts, F.array(b))).otherwise(cuts).alias("cuts"))

        def step(a: Column, b: Column) -> Column:
            over = (a["start"] + most < n) & (b > a["start"] + most) & (a["last"] > a["start"])
            return F.when(over, settle(a["last"], a["last"], F.concat(a["cuts"], F.array(a["last"])), b)).otherwise(settle(a["start"], a["last"], a["cuts"], b))

        marks = F.concat(F.filter(question_boundaries(t), lambda b: b > 0), F.array(n.cast("int")))
        cuts = let(F.aggregate(marks, zero, step, lambda a: a["cuts"]), lambda c: F.array_distinct(F.concat(c, F.array(n.cast("int")))))
        pieces = let(cuts, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: strip(F.substring(t, F.get(c, i - 1) + 1, F.get(c, i) - F.get(c, i - 1)))))
        return F.when(n <= most, F.array(t)).otherwise(F.filter(pieces, lambda p: p != ""))

    return let(text, cut)


def stops_context(text: Column) -> Column:
    """Whether a section of single questions is announced before the first question."""
    first = F.regexp_instr(text, F.lit(r"(?m)^(\*\*|\*)?\d+\s*[\.\)\-:]\s"))
    named = F.regexp_instr(text, F.lit(r"(?imu)^(\*\*|\*)?Question\s+\d+"))
    at = F.when(first > 0, first).otherwise(named)
    return F.when(at > 0, F.substring(text, 1, at - 1)).otherwise(text).rlike(STOPS)


_question = re.compile(r"(\*\*|\*)?(\d+\s*[.)\-:]\s|question\s+\d+)", re.IGNORECASE)
_ends = re.compile(r"(\*\*|\*)?(r[ée]ponse\s*[:.]|\d+[.)\-:]\s)", re.IGNORECASE)
_choice = re.compile(r"(\*\*|\*)?(?!a-t-il\b)[a-f][.)\-:]", re.IGNORECASE)
_case = re.compile(r"(#{1,3}\s*)?(\*\*|\*)?cas\s+clinique", re.IGNORECASE)


def active_context(text: str) -> str:
    """The case narrative that a chunk leaves to the next: prose after its last question, else its case's introduction."""
    lines = text.split("\n")
    asked = [i for i, x in enumerate(lines) if _question.match(x.strip())]
    if asked:
        tail: list[str] = []
        for line in reversed(lines[asked[-1] + 1 :]):
            s = line.strip()
            if s and (_ends.match(s) or _choice.match(s)):
                break
            plain = re.sub(r"[*#_]", "", line).strip()
            told = s and not s.startswith(("|", "[[")) and "fin du cas" not in line.lower() and (len(plain) >= 30 or re.search(r"[.,;:]", plain))
            if told:
                tail.append(line)
        if tail:
            return "\n".join(reversed(tail))
    told, inside = [], False
    for line in lines:
        s = line.strip()
        if _case.match(s):
            told, inside = [line], True
        elif inside and _question.match(s):
            break
        elif inside and re.match(r"#{1,3}\s", s):
            told, inside = [], False
        elif inside and s:
            told.append(line)
    return "\n".join(told)


@F.pandas_udf(StringType())
def _active_context(texts: pd.Series) -> pd.Series:
    return texts.map(active_context)


def exam_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, chunk_index, text, context, is_continuation: a chunk's context is what the one before left, unless it stops it."""
    rows = docs.select(doc_id, F.posexplode(exam_cuts(F.col(text), most)).alias("chunk_index", "text"))
    before = F.lag(_active_context("text")).over(Window.partitionBy(doc_id).orderBy("chunk_index"))
    rows = rows.withColumn("_before", before).withColumn("_stop", stops_context(F.col("text")) & (F.length("text") > 0))
    return rows.select(doc_id, "chunk_index", "text", F.when(F.col("_stop"), "").otherwise(F.coalesce("_before", F.lit(""))).alias("context"), ((F.col("chunk_index") > 0) & ~F.col("_stop")).alias("is_continuation"))


# ── pasted questions ──


def is_question_start(line: Column) -> Column:
    s = strip(line)
    return (s != "") & ~s.rlike(LETTER) & F.regexp_replace(s, NUMBER, "").rlike(CUE)


def has_option(segment: Column) -> Column:
    lines = F.split(segment, LINES)
    return F.exists(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(OPTION))


def split_questions(message: Column, remembered: Column | None = None, most: int = MAX_QUESTIONS, preamble: Column | None = None) -> Column:
    """One text for each question, so that each is searched for itself; the whole message if there are fewer than two.

    A stem without options waits for the piece that has them; one left at the end joins the last. What stands before the
    first question (else the remembered context) leads every piece. A ``preamble`` that isn't null is known to stand before
    the message: no question is looked for in it, whatever its words, and it begins the lead as it is, empty or not.
    """
    told = preamble if preamble is not None else F.lit(None).cast("string")
    memory = F.coalesce(remembered, F.lit("")) if remembered is not None else F.lit("")
    full = F.when(told.isNotNull(), F.concat(told, F.lit("\n"), message)).otherwise(message)
    whole = F.array(F.when(memory != "", strip(F.concat(memory, F.lit("\n\n"), full))).otherwise(full))

    def cut(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(is_question_start(x).alias("q"), i.alias("i")))
        starts = F.transform(F.filter(numbered, lambda x: x["q"]), lambda x: x["i"])

        def merged(s: Column) -> Column:
            stretch = lambda i: strip(F.array_join(F.slice(lines, F.get(s, i) + 1, F.coalesce(F.get(s, i + 1), F.size(lines)) - F.get(s, i)), "\n"))
            pieces = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), stretch), lambda p: p != "")
            zero = F.from_json(F.lit('{"done": [], "open": ""}'), "struct<done: array<string>, open: string>")

            def step(a: Column, p: Column) -> Column:
                return let(F.when(a["open"] != "", F.concat(a["open"], F.lit("\n"), p)).otherwise(p), lambda x: F.struct(F.when(has_option(x), F.concat(a["done"], F.array(x))).otherwise(a["done"]).alias("done"), F.when(has_option(x), F.lit("")).otherwise(x).alias("open")))

            def finish(a: Column) -> Column:
                n = F.size(a["done"])
                joined = F.concat(F.slice(a["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(a["done"], -1), F.lit("\n"), a["open"])))
                return F.when(a["open"] == "", a["done"]).when(n > 0, joined).otherwise(F.array(a["open"]))

            own = strip(F.array_join(F.slice(lines, 1, F.get(s, F.lit(0))), "\n"))
            lead = let(own, lambda x: F.when(told.isNotNull(), F.when(x != "", F.concat(told, F.lit("\n"), x)).otherwise(told)).when(x != "", x).otherwise(memory))
            led = lambda parts: let(lead, lambda h: F.transform(parts, lambda p: F.when(told.isNotNull() | (h != ""), F.concat(h, F.lit("\n\n"), p)).otherwise(p)))
            return let(F.aggregate(pieces, zero, step, finish), lambda parts: F.when(F.size(parts) < 2, whole).otherwise(F.slice(led(parts), 1, most)))

        return let(starts, lambda s: F.when(F.size(s) < 2, whole).otherwise(merged(s)))

    return let(F.split(message, LINES), cut)


def first_question_number(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, FIRST_QUESTION, 1), F.lit("")).cast("int")


def leading_context(message: Column) -> Column:
    at = F.regexp_instr(message, F.lit(FIRST_QUESTION))
    return F.when(at > 1, strip(F.substring(message, 1, at - 1))).otherwise("")


def detect_case(message: Column, remembered: Column) -> Column:
    """'new', 'continuation' or 'ask' (left to a model)."""
    return F.when(message.rlike(CASE_HEADER) | (F.coalesce(remembered, F.lit("")) == ""), "new").when(first_question_number(message) > 1, "continuation").otherwise("ask")


def next_context(message: Column, remembered: Column, is_new: Column) -> Column:
    lead = leading_context(message)
    return F.when(is_new, lead).otherwise(strip(F.concat(F.coalesce(remembered, F.lit("")), F.when(lead != "", F.concat(F.lit("\n\n"), lead)).otherwise(""))))


# ── cases and questions of a document ──


def fill_case_text(rows: DataFrame, group: str, order: str, text: str = "case_text", case: str = "case_index", seed: Column | None = None, clinical: bool = False) -> DataFrame:
    """A case's text, given once, on its later questions: only where the mode or the question's case index says so."""
    given = F.nullif(strip(F.col(text)), F.lit(""))
    own = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.coalesce(F.last(given, True).over(own), F.nullif(strip(seed), F.lit("")) if seed is not None else F.lit(None))
    return rows.withColumn("filled", F.when(given.isNotNull(), F.col(text)).when(F.lit(clinical) | F.col(case).isNotNull(), F.coalesce(last, F.col(text))).otherwise(F.col(text)))


def case_updates(questions: DataFrame) -> DataFrame:
    """doc_id, case_id, part, type, text, from_index from (doc_id, case_id, intro, question_index, context).

    A context that changed adds an update, unless it holds or is held by an earlier part. Sequential inside a case, so
    a case is a group; a case has few questions.
    """
    doc, case = (questions.schema[c].dataType.simpleString() for c in ("doc_id", "case_id"))

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        squash = lambda t: "".join(t.split()).lower()
        pdf = pdf.sort_values("question_index")
        intro = pdf["intro"].iloc[0] or ""
        parts, last = [("CASE_INTRO", intro, int(pdf["question_index"].iloc[0]))], intro.strip()
        for at, context in zip(pdf["question_index"], pdf["context"], strict=True):
            now = (context or "").strip()
            if squash(now) and squash(now) != squash(last):
                new = now.lstrip("\n -+*")
                held = [squash(p[1]) for p in parts]
                if new and not any(squash(new) in h or h in squash(new) for h in held):
                    parts.append(("CASE_UPDATE", new, int(at)))
                last = now
        return pd.DataFrame([(*key, i, *p) for i, p in enumerate(parts)], columns=["doc_id", "case_id", "part", "type", "text", "from_index"])

    return questions.groupBy("doc_id", "case_id").applyInPandas(fold, f"doc_id {doc}, case_id {case}, part int, type string, text string, from_index int")


def case_groups(questions: DataFrame) -> DataFrame:
    """doc_id, case_id, first question and the sorted list of question indices."""
    return questions.where("case_id IS NOT NULL").groupBy("doc_id", "case_id").agg(F.min("question_index").alias("from_index"), F.sort_array(F.collect_list("question_index")).alias("question_indices"))


def globalize_cases(found: DataFrame, force_first: bool = False) -> DataFrame:
    """Local case numbers of a document's chunks as document-wide ones: doc_id, chunk_index, ord, case_id, is_child.

    ``found``: doc_id, chunk_index, ord, is_child, local_id, names, intros (arrays of the chunk's cases), context,
    is_continuation. A local case is an earlier one if it continues the active context, if the intros' beginnings are
    held by one another, or if the names (other than numbered ones) agree; else it is new. One group a document.
    """
    kind = found.schema["doc_id"].dataType.simpleString()

    def key_of(t) -> str:
        return re.sub(r"[^a-z0-9]", "", re.sub(r"n[°0o]", "", str(t or "").lower()))

    def same(a: str, b: str) -> bool:
        return a[:30] in b or b[:30] in a

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        cases: list[tuple[str, str]] = []  # (name, intro), as keys
        out = []
        for (chunk, ord_, child, local, names, intros, context, continues) in pdf.sort_values(["chunk_index", "ord"])[["chunk_index", "ord", "is_child", "local_id", "names", "intros", "context", "is_continuation"]].itertuples(index=False):
            case = None
            if child:
                active = key_of(context)
                if force_first and continues and local == 0 and cases:
                    case = len(cases) - 1
                elif pd.notna(local) and 0 <= local < len(names):
                    name, intro = key_of(names[int(local)]), key_of(intros[int(local)])
                    if len(intro) > 15:
                        if active and same(intro, active) and cases:
                            case = len(cases) - 1
                        else:
                            case = next((i for i, (_, seen) in enumerate(cases) if len(seen) > 15 and same(intro, seen)), None)
                    if case is None and name and not re.fullmatch(r"casclinique\d*", name):
                        case = next((i for i, (known, _) in enumerate(cases) if known == name), None)
                    if case is None:
                        case = len(cases)
                        cases.append((name, intro))
                elif cases and context:
                    case = len(cases) - 1
            out.append((key[0], int(chunk), int(ord_), case, bool(child) and case is not None))
        frame = pd.DataFrame(out, columns=["doc_id", "chunk_index", "ord", "case_id", "is_child"])
        return frame.astype({"case_id": "Int32"})

    return found.groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, chunk_index int, ord int, case_id int, is_child boolean")


def dominant(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, dominant): the most frequent non-empty value; ties to the one met first."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "first"))
    return counts.withColumn("_r", best).where("_r = 1").select(group, F.col(value).alias("dominant"))


def by_course(questions: DataFrame, doc: str = "doc_id", course: str = "course", order: str = "ord", unnamed: str = "Non classé") -> DataFrame:
    """Questions with global_index, course (named) and course_order: courses in the order first met."""
    named = questions.withColumn(course, F.coalesce(F.nullif(F.col(course), F.lit("")), F.lit(unnamed)))
    whole = Window.partitionBy(doc).orderBy(order)
    first = F.min(order).over(Window.partitionBy(doc, course))
    out = named.withColumn("global_index", F.row_number().over(whole) - 1).withColumn("_first", first)
    return out.withColumn("course_order", F.dense_rank().over(Window.partitionBy(doc).orderBy("_first")) - 1).drop("_first")


def place_images(marks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """As-of join: doc_id, pos, key with the last boundary (doc_id, pos) at or before it; null before the first."""
    both = marks.select("doc_id", "pos", "key", F.lit(1).alias("o"), F.lit(None).cast("int").alias("b")).unionByName(boundaries.select("doc_id", "pos", F.lit(None).cast("string").alias("key"), F.lit(0).alias("o"), F.col("pos").cast("int").alias("b")))
    last = F.last("b", True).over(Window.partitionBy("doc_id").orderBy("pos", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("boundary", last).where("o = 1").select("doc_id", "pos", "key", "boundary")


