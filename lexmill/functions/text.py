"""Column helpers for text. White space means what Python's ``str.strip`` means, in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class that Java, RE2 and Python's re read alike (fixed value).
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = rf"\A{SPACE}+|{SPACE}+\z"
#: The same characters, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """What replacing ``STRIP`` gives, looking at the ends only."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """White space runs become one space; the ends are stripped."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def present(c: Column) -> Column:
    """Null for a null or empty string."""
    return F.nullif(c, F.lit(""))


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower: not ``initcap``, which does so for every word."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def case_variants(value: Column) -> Column:
    """The spellings that a metadata filter takes for equal: as given, upper, lower, capitalised."""
    return F.array_distinct(F.array(value, F.upper(value), F.lower(value), capitalize(value)))


def strip_markup(html: Column) -> Column:
    """Text between tags, tags counting as spaces."""
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def informative(text: Column) -> Column:
    """What a section says: without its first paragraph's heading, figure or table marker, and credit lines."""
    at = F.instr(text, "\n\n")
    body = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text)
    body = F.regexp_replace(body, rf"(?iu)\A{SPACE}*(figure|tableau){SPACE}*:{SPACE}*", "")
    return squeeze(F.regexp_replace(body, r"(?m)^[^\n]*©[^\n]*$", ""))


def is_empty_section(text: Column, least_chars: int = 15, least_letters: int = 3) -> Column:
    body = informative(text)
    return (F.length(body) < least_chars) | (letters(body) < least_letters)


#: What a question asks for: patterns in order, the first that fits decides (fixed values).
KIND_SIGNALS = (
    ("table", r"(?iu)\b(dose|posologie|mg\b|mg/kg|combien|µg|UI\b|crit[èe]res?|classification|score|stades?|seuils?|valeurs?\s+normales?)"),
    ("callout", r"(?iu)\b(algorithme|conduite\s+[àa]\s+tenir|CAT\b|d[ée]marche|quand\s+(?:faut-il|doit)|arbre\s+d[ée]cisionnel|[àa]\s+retenir)"),
)


def boosted_kind(query: Column) -> Column:
    out = None
    for kind, pattern in KIND_SIGNALS:
        out = F.when(query.rlike(pattern), kind) if out is None else out.when(query.rlike(pattern), kind)
    return out


def slug(text: Column, most: int = 60) -> Column:
    """ASCII letters and digits; runs of spaces and hyphens become one underscore."""
    plain = strip(F.regexp_replace(text, r"[^a-zA-Z0-9\-\x{09}-\x{0D}\x{20}]", ""))
    return F.substring(F.regexp_replace(plain, rf"(-|{SPACE})+", "_"), 1, most)


def normal_key(text: Column) -> Column:
    """Lower case, number markers dropped, only a-z and 0-9 kept."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "n[°0o]", ""), "[^a-z0-9]", "")


def bare(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, f"{SPACE}+", ""))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once per row for ``body``."""
    return F.transform(F.array(value), body)[0]
