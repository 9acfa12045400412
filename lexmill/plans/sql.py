"""Pieces of DuckDB SQL for the oracles of the registered queries."""

from lexmill.functions.text import SPACE, STRIP


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '{STRIP}', '', 'g')"


def units(text: str) -> str:
    ends = rf"regexp_replace({strip(text)}, '([.!?]){SPACE}+', '\1' || chr(2), 'g')"
    bullets = rf"regexp_replace({ends}, '({SPACE}*[•▪◦⇒⇨①-⑳]{SPACE})', chr(2) || '\1', 'g')"
    return rf"list_filter(list_transform(regexp_split_to_array({bullets}, '\n+|\x02'), lambda x: {strip('x')}), lambda x: x <> '')"


def windows(units_list: str, target: int = 450) -> str:
    """Of a non-empty list."""
    state = f"list_transform({units_list}, lambda u: {{'w': []::VARCHAR[], 'c': [u], 'n': length(u)}})"
    keep = f"length(a.c[-1]) <= {target // 2}"
    step = (
        f"lambda a, b: CASE WHEN a.n + b.n > {target} THEN {{'w': list_append(a.w, array_to_string(a.c, chr(10))),"
        f" 'c': CASE WHEN {keep} THEN [a.c[-1], b.c[1]] ELSE b.c END, 'n': CASE WHEN {keep} THEN length(a.c[-1]) ELSE 0 END + b.n}}"
        " ELSE {'w': a.w, 'c': list_append(a.c, b.c[1]), 'n': a.n + b.n} END"
    )
    return f"list_transform([list_reduce({state}, {step})], lambda s: list_append(s.w, array_to_string(s.c, chr(10))))[1]"


def pieces(text: str, separators: tuple[str, ...], most: int = 1500, depth: int = 0) -> str:
    """The recursive split of a stripped text, as nested reductions."""
    if not separators:
        return f"[{text}]"
    sep, a, b, p = "||".join(f"chr({ord(c)})" for c in separators[0]), f"a{depth}", f"b{depth}", f"p{depth}"
    joined = f"(CASE WHEN {a}.o <> '' THEN {a}.o || {sep} || {b}.p ELSE {b}.p END)"
    closed = f"(CASE WHEN {a}.o <> '' THEN list_append({a}.d, {a}.o) ELSE {a}.d END)"
    inner = pieces(strip(f"{b}.p"), separators[1:], most, depth + 1)
    step = (
        f"lambda {a}, {b}: CASE WHEN length({joined}) <= {most} THEN {{'d': {a}.d, 'o': {joined}, 'p': ''}}"
        f" WHEN length({b}.p) > {most} THEN {{'d': {closed} || {inner}, 'o': '', 'p': ''}} ELSE {{'d': {closed}, 'o': {b}.p, 'p': ''}} END"
    )
    start = f"list_prepend({{'d': []::VARCHAR[], 'o': '', 'p': ''}}, list_transform(string_split({text}, {sep}), lambda {p}: {{'d': []::VARCHAR[], 'o': '', 'p': {p}}}))"
    done = f"list_transform([list_reduce({start}, {step})], lambda s{depth}: CASE WHEN {strip(f's{depth}.o')} <> '' THEN list_append(s{depth}.d, s{depth}.o) ELSE s{depth}.d END)[1]"
    cut = f"list_filter(list_transform({done}, lambda q{depth}: {strip(f'q{depth}')}), lambda q{depth}: q{depth} <> '')"
    return f"(CASE WHEN {text} = '' THEN []::VARCHAR[] WHEN length({text}) <= {most} THEN [{text}] ELSE {cut} END)"


def informative(x: str) -> str:
    body = rf"(CASE WHEN position(chr(10)||chr(10) IN {x}) > 0 THEN substring({x}, position(chr(10)||chr(10) IN {x}) + 2) ELSE {x} END)"
    body = rf"regexp_replace({body}, '(?i)\A{SPACE}*(figure|tableau){SPACE}*:{SPACE}*', '')"
    return strip(rf"regexp_replace(regexp_replace({body}, '(?m)^[^\n]*©[^\n]*$', '', 'g'), '{SPACE}+', ' ', 'g')")


def empty_section(x: str) -> str:
    return rf"(length({informative(x)}) < 15 OR length(regexp_replace({informative(x)}, '[^\p{{L}}]', '', 'g')) < 3)"


def variants(x: str) -> str:
    return f"[{x}, upper({x}), lower({x}), upper({x}[1]) || lower(substring({x}, 2))]"
