"""Text to parent chunks to child chunks, all in array expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.pack import pack_windows
from lexmill.functions.text import SPACE, let, strip

SEPARATORS = ("\n\n", "\n", ". ")
PARENT_CHARS = 1500
CHILD_CHARS, CHILD_OVERLAP = 450, 1
_PLAIN_UNIT = rf"\n+|(?<=[.!?]){SPACE}+"
_UNIT = rf"{_PLAIN_UNIT}|(?={SPACE}*[•▪◦⇒⇨]{SPACE})|(?={SPACE}*[①-⑳]{SPACE})"
_MARKER = r"<!--loc:(page|section)=([^\n]*?)-->"


def split_units(text: Column) -> Column:
    """The smallest pieces: at newlines, after sentence ends, before bullets and circled digits."""
    cut = let(strip(text), lambda t: F.when(t.rlike("[•▪◦⇒⇨①-⑳]"), F.split(t, _UNIT)).otherwise(F.split(t, _PLAIN_UNIT)))
    return F.filter(F.transform(cut, strip), lambda u: u != "")


def child_windows(text: Column, target: int = CHILD_CHARS, overlap: int = CHILD_OVERLAP) -> Column:
    """The windows to embed of a parent; the whole text if it has no unit."""
    windows = pack_windows(split_units(text), target, overlap)
    return F.filter(let(windows, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(text))), lambda w: strip(w) != "")


def recursive_split(text: Column, separators: tuple[str, ...] = SEPARATORS, most: int = PARENT_CHARS) -> Column:
    """Pieces of at most ``most`` characters along the first separator, longer parts along the next.

    A piece stays longer where the separators run out. One nested fold for each separator, so no recursion at run time.
    """
    return let(strip(text), lambda t: F.when(t == "", F.array().cast("array<string>")).when((F.length(t) <= most) | F.lit(not separators), F.array(t)).otherwise(_along(t, separators, most) if separators else F.array(t)))


def _along(text: Column, separators: tuple[str, ...], most: int) -> Column:
    first, rest = separators[0], separators[1:]
    zero = F.from_json(F.lit('{"done": [], "open": ""}'), "struct<done: array<string>, open: string>")

    def step(a: Column, part: Column) -> Column:
        joined = F.when(a["open"] != "", F.concat(a["open"], F.lit(first), part)).otherwise(part)
        fits = F.length(joined) <= most
        closed = F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        large = F.length(part) > most
        return F.struct(
            F.when(fits, a["done"]).when(large, F.concat(closed, recursive_split(part, rest, most))).otherwise(closed).alias("done"),
            F.when(fits, joined).when(large, F.lit("")).otherwise(part).alias("open"),
        )

    parts = F.split(text, rf"\Q{first}\E", -1)
    pieces = F.aggregate(parts, zero, step, lambda a: F.when(strip(a["open"]) != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def unmarked(text: Column) -> Column:
    """Location markers in ``text`` made plain content of the same length, for texts that are to be put between markers."""
    return F.replace(text, F.lit("<!--loc:"), F.lit("<!--loc "))


def locate(text: Column, blank: bool = False) -> Column:
    """array<struct<page, section, text>>: the stretches between location markers, blank ones left out unless ``blank``.

    A page marker clears the section, and sets a null page if it isn't a number. Without any stretch: the whole text.
    """
    kinds, values = F.regexp_extract_all(text, F.lit(_MARKER), F.lit(1)), F.regexp_extract_all(text, F.lit(_MARKER), F.lit(2))
    stretches = F.split(text, _MARKER, -1)
    steps = F.zip_with(F.concat(F.array(F.lit("none")), kinds), F.zip_with(F.concat(F.array(F.lit("")), values), stretches, lambda v, s: F.struct(strip(v).alias("v"), s.alias("s"))), lambda k, x: F.struct(k.alias("k"), x["v"].alias("v"), x["s"].alias("s")))
    zero = F.from_json(F.lit('{"out": []}'), "struct<page: int, section: string, out: array<struct<page: int, section: string, text: string>>>")

    def step(a: Column, x: Column) -> Column:
        page = F.when(x["k"] == "page", F.when(x["v"].rlike("^[0-9]+$"), x["v"].cast("int"))).otherwise(a["page"])
        section = F.when(x["k"] == "page", F.lit(None).cast("string")).when(x["k"] == "section", F.nullif(x["v"], F.lit(""))).otherwise(a["section"])
        here = F.struct(page.alias("page"), section.alias("section"), x["s"].alias("text"))
        return F.struct(page.alias("page"), section.alias("section"), F.when(F.lit(blank) | (strip(x["s"]) != ""), F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"))

    whole = F.array(F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), text.alias("text")))
    marked = let(F.aggregate(steps, zero, step, lambda a: a["out"]), lambda out: F.when(F.size(out) > 0, out).otherwise(whole))
    return F.when(F.contains(text, F.lit("<!--loc:")), marked).when(text.isNotNull(), whole)


def chunk_id(*parts: Column) -> Column:
    """A stable id, so that reruns give the rows they gave."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256).substr(1, 32)


def parent_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = PARENT_CHARS) -> DataFrame:
    """One row for each parent: doc_id, parent_index, parent_id, page, section, parent_text; other columns are kept."""
    pieces = F.flatten(F.transform(locate(F.col(text)), lambda s: F.transform(recursive_split(s["text"], SEPARATORS, most), lambda p: F.struct(s["page"].alias("page"), s["section"].alias("section"), p.alias("text")))))
    rows = docs.select(*[c for c in docs.columns if c != text], F.posexplode(pieces).alias("parent_index", "_p"))
    return rows.select(*[c for c in docs.columns if c != text], "parent_index", chunk_id(F.col(doc_id), F.col("parent_index")).alias("parent_id"), "_p.page", "_p.section", F.col("_p.text").alias("parent_text"))


def child_chunks(parents: DataFrame, target: int = CHILD_CHARS, overlap: int = CHILD_OVERLAP) -> DataFrame:
    """One row for each window of each parent: the parent's columns but its text, child_index, chunk_id, text.

    Parents' texts stay in their own table; join them by parent_id where they are needed.
    """
    rows = parents.select(*[c for c in parents.columns if c != "parent_text"], F.posexplode(child_windows(F.col("parent_text"), target, overlap)).alias("child_index", "text"))
    return rows.withColumn("chunk_id", chunk_id(F.col("parent_id"), F.col("child_index")))


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents to child chunks."""
    return child_chunks(parent_chunks(docs, doc_id, text))


def metadata_prefix(module: Column, course: Column, year: Column, kind: Column, full: bool = False) -> Column:
    """[Module: .. | Course: .. | Year: .. | Type: ..] of what is present (``full``: of what isn't null), else empty."""
    part = lambda label, c: F.when(c.isNotNull() & (F.lit(full) | (c.cast("string") != "")), F.concat(F.lit(f"{label}: "), c.cast("string")))
    joined = F.concat_ws(" | ", part("Module", module), part("Course", course), part("Year", year), part("Type", kind))
    return F.when(joined != "", F.concat(F.lit("["), joined, F.lit("]"))).otherwise("")


def context_prefix(text: Column, section_path: Column, page_label: Column, metadata: Column, full: bool = False) -> Column:
    """Section trail (unless the text opens with it), printed page, and metadata; ``full``: the whole trail as it is, in any case."""
    parts = F.coalesce(section_path, F.array().cast("array<string>"))
    path = F.array_join(parts if full else F.filter(parts, lambda p: p != ""), " > ")
    opens = F.lit(not full) & F.regexp_replace(text, rf"\A{SPACE}+", "").startswith(F.substring(path, 1, 40))
    head = F.concat_ws(" — ", F.when((path != "") & ~opens, path), F.when(page_label.isNotNull() & (page_label != ""), F.concat(F.lit("p. "), page_label)))
    both = F.concat(head, F.lit(" "), metadata)
    return F.when(head != "", both if full else strip(both)).otherwise(metadata)


def enrich(text: Column, prefix: Column, sentence: Column | None = None) -> Column:
    """The text to embed: prefix and an optional sentence of a model, where there are any, and the chunk, joined by spaces; null for a null chunk."""
    before = [F.when(p != "", F.concat(p, F.lit(" "))) for p in ([prefix, sentence] if sentence is not None else [prefix])]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in before], text)
