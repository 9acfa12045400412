"""Repair of conversation structure: the cheapest edits that leave ``s?(ua)+`` or nothing, by a retained-subsequence DP.

A turn is kept or gets another role (it is retained), or it is deleted; empty turns are put between. The state is the role
of the last retained turn. What a gap between two retained turns costs is the difference of two prefix sums of deletions and
the inserts that the pair of roles demands, so the best next retained turn of each role is one running minimum a role, taken
from the end. A walk from the start then takes, among the cheapest ways on, the one whose letter comes first; as a state and
a letter fix the next state, that is the least audit.

Turns are dealt by range of (conversation, turn), so a conversation of any length lies in consecutive segments. Segments of
conversations that may reach beyond a partition (two a partition at most) are first reduced to their costs from each state to
each; these, one row a segment, give the costs at the segments' ends and then the states in which they are entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checkpointed, sized, spread

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
#: States: nothing retained yet, or the last retained role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The role that an inserted or reroled turn must have after each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserts that a pair of states demands between them.
BETWEEN = ((NEVER, 0, 0, 1), (NEVER, NEVER, 0, 1), (NEVER, NEVER, 1, 0), (NEVER, NEVER, 0, 1))
#: Costs at a conversation's end: the inserts that complete the last pair.
ENDS = (0, 2 * INSERT, INSERT, 0)
#: Turns, and bytes of text, of a partition.
PART_ROWS, PART_BYTES = 16_384, 8 << 20
#: Characters of repaired text that travel together.
PIECE_CHARS = 1 << 20
SPACES = " \\t\\n\\u000b\\f\\r"


def _own(row: tuple, role: int) -> int:
    """What retaining a turn in ``role`` costs; its further copies are deleted."""
    initial, fault, times = row[:3]
    if fault in ("blank", "duplicate"):
        return NEVER
    cost = KEEP if INITIALS.get(initial) == role else REROLE if role != SYSTEM else NEVER
    return cost + (TRUNCATED if fault == "truncated" else 0) + DELETE * (times - 1)


def costs_to_go(rows: list[tuple], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each place before a row, and behind the last, the least cost from each state on; ``end`` are those behind the rows."""
    deleted = [0]
    for row in rows:
        deleted.append(deleted[-1] + DELETE * row[2])
    best = [NEVER] * 4  # of each role, the least of deletions so far + costs from its next retained turn on
    out = [end]
    for i in range(len(rows) - 1, -1, -1):
        after = out[-1]
        for role in (SYSTEM, USER, ASSISTANT):
            best[role] = min(best[role], deleted[i] + _own(rows[i], role) + after[role])
        to_end = deleted[-1] - deleted[i]
        out.append(tuple(min(end[p] + to_end, *(best[r] + INSERT * BETWEEN[p][r] - deleted[i] for r in (SYSTEM, USER, ASSISTANT))) for p in range(4)))
    return out[::-1]


def walk(rows: list[tuple], to_go: list[tuple[int, ...]], state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """(letters, row or -1, state after it) of the cheapest edits from ``state``, letters in ASCII's least order.

    ``last`` tells whether the conversation ends behind the rows; else inserts there are left to the next segment.
    """
    for i, row in enumerate(rows):
        while True:
            cost, again = to_go[i][state], "D" * (row[2] - 1)
            if DELETE * row[2] + to_go[i + 1][state] == cost:
                yield "D" + again, i, state
                break
            if INSERT + to_go[i][NEXT[state]] == cost:
                state = NEXT[state]
                yield "I", -1, state
                continue
            kept = INITIALS.get(row[0], START)
            keeps = kept != START and BETWEEN[state][kept] == 0 and _own(row, kept) + to_go[i + 1][kept] == cost
            state = kept if keeps else NEXT[state]
            yield ("K" if keeps else "R") + again, i, state
            break
    while last and ENDS[state]:
        state = NEXT[state]
        yield "I", -1, state


def _framed(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of some hundreds, or of fewer if their texts (last) are long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= 512 or size >= PIECE_CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _illegal(before: str | None, initial: str, times: int = 1) -> int:
    """Pairs of neighbours that aren't su, ua or au: the first with ``before``, and a turn's further copies."""
    return (before is not None and before + initial not in ("su", "ua", "au")) + times - 1


def _runs(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, list[tuple], tuple]]:
    """((part, conversation), its rows, further columns of its first row) of rows sorted by them; one run is held at a time."""
    key, rows, more = None, [], ()
    for pdf in frames:
        for part, conv, initial, fault, times, *rest in zip(*[pdf[c].tolist() for c in ("part", "conv", "initial", "fault", "times", *columns)], strict=True):
            if (part, conv) != key:
                if rows:
                    yield key, rows, more
                key, rows, more = (part, conv), [], rest
            rows.append((initial, fault, times, *rest[:2]))
    if rows:
        yield key, rows, more


def _open(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition's first and last conversation: costs from each state to each over its rows here."""
    first, held = True, None
    for key, rows, _ in _runs(frames, []):
        if first:
            yield _summary(key, rows)
        first, held = False, (key, rows) if not first else None
    if held:
        yield _summary(*held)


def _summary(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    # column by column: what it costs to leave in state q
    by_exit = [costs_to_go(rows, tuple(0 if p == q else NEVER for p in range(4)))[0] for q in range(4)]
    return pd.DataFrame([(*key, [min(by_exit[q][p], NEVER) for p in range(4) for q in range(4)])], columns=["part", "conv", "costs"])


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The costs to go at each segment's end, from the last segment back."""
    pdf, to_go, out = pdf.sort_values("part"), ENDS, []
    for part, conv, costs in reversed(list(zip(pdf["part"], pdf["conv"], pdf["costs"], strict=True))):
        out.append((part, conv, list(to_go), len(out) == 0))
        to_go = [min(NEVER, *(int(costs[4 * p + q]) + to_go[q] for q in range(4))) for p in range(4)]
    return pd.DataFrame(out, columns=["part", "conv", "to_go", "last"])


def _exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which a segment is left, for each in which it may be entered."""
    for key, rows, (to_go, last) in _runs(frames, ["to_go", "last"]):
        costs, exits = costs_to_go(rows, tuple(int(x) for x in to_go)), []
        for state in range(4):
            if costs[0][state] < NEVER // 2:
                for _, _, state in walk(rows, costs, state, last):  # noqa: B007, PLW2901
                    pass
            exits.append(state)
        yield pd.DataFrame([(*key, list(map(int, to_go)), last, exits)], columns=["part", "conv", "to_go", "last", "exits"])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment is entered, from the first segment on."""
    pdf, state, entries = pdf.sort_values("part"), START, []
    for exits in pdf["exits"]:
        entries.append(state)
        state = int(exits[state])
    return pdf.assign(entry=entries)[["part", "conv", "to_go", "last", "entry"]]


def _repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of repaired conversations, in order."""
    return _framed(_pieces(frames), ["part", "conv", "piece", "whole", "first", "final", "illegal", "cost", "audit", "text"])


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(part, conv, piece, whole, first, final, illegal, cost, audit, text) of repaired conversations, in order."""
    for (part, conv), rows, (_, _, to_go, last, entry) in _runs(frames, ["role", "text", "to_go", "last", "entry"]):
        whole = to_go is None
        end, state = (ENDS, START) if whole else (tuple(int(x) for x in to_go), int(entry))
        costs, before, illegal = costs_to_go(rows, end), None, 0
        for row in rows:
            illegal += _illegal(before, row[0], row[2])
            before = row[0]
        total = costs[0][START] if state == START else 0
        out, letters, texts, n = [], [], [], 0

        def piece() -> None:
            out.append((part, conv, len(out), whole, rows[0][0], before, illegal if not out else 0, total if not out else 0, "".join(letters), "\n".join(texts)))  # noqa: B023
            letters.clear(), texts.clear()  # noqa: B023

        for letter, i, state in walk(rows, costs, state, whole or last):  # noqa: B007
            letters.append(letter)
            if letter[0] != "D":
                role, text = (NAMES[state], "") if i < 0 else (rows[i][3] if letter[0] == "K" else NAMES[state], rows[i][4])
                texts.append(f"{role}:{text}")
                n += len(texts[-1])
            if n >= PIECE_CHARS and not whole:
                piece()
                n = 0
        piece()
        if whole:
            out = [(*out[0][:-1], hashlib.sha256(out[0][-1].encode("utf-8", "surrogatepass")).hexdigest())]
        yield from out


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations from their pieces, sorted by (conv, part, piece); a text is hashed as it streams by."""
    conv = None

    def done() -> pd.DataFrame:
        return pd.DataFrame([(conv, illegal, cost, "".join(audit), digest.hexdigest())], columns=["conv", "illegal", "cost", "audit", "repaired_sha256"])

    for pdf in frames:
        for c, part, first, final, more, price, letters, text in zip(*[pdf[x].tolist() for x in ("conv", "part", "first", "final", "illegal", "cost", "audit", "text")], strict=True):
            if c != conv:
                if conv is not None:
                    yield done()
                conv, at, before, illegal, cost, audit, digest, some = c, None, None, 0, price, [], hashlib.sha256(), False
            if part != at:
                illegal += _illegal(before, first) if before is not None else 0
                at, before = part, final
            illegal += more
            audit.append(letters)
            if text:
                digest.update(("\n" * some + text).encode("utf-8", "surrogatepass"))
                some = True
    if conv is not None:
        yield done()


def repair_conversations(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in ``turns``.

    ``turns`` has conv_id, turn, role and text; other columns don't matter. ``conv`` is conv_id as text, a space for null:
    turns without an id are one conversation. Turns are taken by turn (nulls first), ties by role, then text. A null role or
    text is one space. Equal rows are one row with a count until they are edited. gaps is null where the range of turns
    exceeds a long. An empty table gives no rows; texts may be empty or of any length.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(text("conv_id").alias("conv"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = checkpointed(rows.groupBy("conv", "conv_id", "turn", "role", "text").agg(F.count("*").alias("times")))
    # the first of equal role and text is told by its turn; only such as stand at several turns are joined
    own = F.unhex(F.sha2("text", 256))
    seen = rows.groupBy("conv", "role", own.alias("hash")).agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("earliest")).where("n > 1")
    seen = sized(checkpointed(seen.drop("n")))
    rows = rows.withColumn("hash", own).join(seen, ["conv", "role", "hash"], "left").drop("hash")
    again = F.col("earliest").isNotNull() & ~F.col("earliest.turn").eqNullSafe(F.col("turn"))
    bare = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    fault = F.when(bare == "", "blank").when(again, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("conv", "conv_id", "turn", "role", "text", "times", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    rows = checkpointed(rows)
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(spread(n, part_rows), spread(size or 0, PART_BYTES))
    order = ["conv", F.asc_nulls_first("turn"), "role"]
    ordered = rows.drop("conv_id").repartitionByRange(parts, *order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    ordered = checkpointed(ordered).withColumn("part", F.spark_partition_id())

    segments = checkpointed(ordered.mapInPandas(_open, "part int, conv string, costs array<long>"))
    several = segments.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")
    segments = segments.join(several, "conv", "left_semi")
    ends = checkpointed(segments.groupBy("conv").applyInPandas(_ends, "part int, conv string, to_go array<long>, last boolean"))
    at = ["part", "conv"]
    # a broadcast keeps partitions and their order; beyond it a segment's turns meet anew
    held = lambda side, how: ordered.join(sized(side), at, how).sortWithinPartitions(*at, *order[1:], "text")
    exits = held(ends, "inner").mapInPandas(_exits, "part int, conv string, to_go array<long>, last boolean, exits array<int>")
    entries = checkpointed(exits.groupBy("conv").applyInPandas(_entries, "part int, conv string, to_go array<long>, last boolean, entry int"))
    pieces = "part int, conv string, piece int, whole boolean, first string, final string, illegal long, cost long, audit string, text string"
    pieces = checkpointed(held(entries, "left").mapInPandas(_repair, pieces))
    result = "conv string, illegal long, cost long, audit string, repaired_sha256 string"
    gathered = pieces.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "part", "piece").mapInPandas(_joined, result)
    repaired = pieces.where("whole").select("conv", "illegal", "cost", "audit", F.col("text").alias("repaired_sha256")).unionByName(gathered)

    count = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
    gaps = F.expr("try_add(try_subtract(max(turn), min(turn)), 1 - count(DISTINCT turn))")
    stats = rows.groupBy("conv", "conv_id").agg(
        F.when(F.count("turn") == 0, 0).otherwise(gaps).cast("long").alias("gaps"),
        count(F.when(F.col("fault") == "blank", F.col("times"))).alias("blank"),
        count(F.when(F.col("fault") == "duplicate", F.col("times")).when(F.col("fault") != "blank", F.col("times") - 1)).alias("duplicate"),
        count(F.when(F.col("fault") == "truncated", 1)).alias("truncated"),
    )
    return stats.join(repaired, "conv").select("conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, told by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops a row, 1 empties its text, 2 takes ``[.!?]`` from it, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("fate"))
    new: dict[str, Column] = {
        "text": F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))),
    }
    return rows.where("fate <> 0").withColumns(new).select("conv_id", "turn", "role", "text")


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """Every conv_id of ``conversations`` with the repair of its damaged rows; one whose rows were all dropped has zeros."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"))
    out = ids.join(repair_conversations(damaged(conversations)).drop("conv_id"), "conv", "left").drop("conv")
    zeros = dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], F.lit(0).cast("long")) | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    # gaps may be null in its own right
    return out.select("conv_id", *[F.when(F.col("audit").isNull(), z).otherwise(F.col(c)).alias(c) for c, z in zeros.items()])


def _option(cost: str, letter: str, line: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': {letter} || {rest}.a, 't': {line} || {rest}.t}}"


def _step(p: int) -> str:
    """SQL: the least (cost, audit, text) from state ``p`` before a row on, without inserts ahead of it."""
    to = NEXT[p]
    out = [_option("4", "'D'", "''", f"v{p}")]
    for initial, q in INITIALS.items():
        if BETWEEN[p][q] == 0:
            out.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND ini = '{initial}' THEN {_option('price', chr(39) + 'K' + chr(39), 'chr(10) || role || chr(58) || text', f'v{q}')} END")
    out.append(f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {_option('3 + price', chr(39) + 'R' + chr(39), f'chr(10) || {chr(39)}{NAMES[to]}:{chr(39)} || text', f'v{to}')} END")
    return f"list_sort(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))[1]"


def _closed(p: int) -> str:
    """SQL: the same with up to two inserts ahead."""
    one, two = NEXT[p], NEXT[NEXT[p]]
    first = f"chr(10) || '{NAMES[one]}:'"
    return f"list_sort([w{p}, {_option('3', chr(39) + 'I' + chr(39), first, f'w{one}')}, {_option('6', chr(39) + 'II' + chr(39), first + f' || chr(10) || {chr(39)}{NAMES[two]}:{chr(39)}', f'w{two}')}])[1]"


#: crc32 by bytes of an ASCII text, as DuckDB has none.
_CRC = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
fated AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d0 AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS fate FROM fated, crc)
""".strip()

ORACLE = f"""
WITH RECURSIVE {_CRC},
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM d0, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
m AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM n),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM m),
p AS (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS price FROM f),
stats AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM p GROUP BY conv_id),
r AS (SELECT conv_id, rows AS i, {{'c': 0, 'a': '', 't': ''}} AS v0, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS v1, {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}} AS v2, {{'c': 0, 'a': '', 't': ''}} AS v3 FROM stats
  UNION ALL
  SELECT conv_id, i - 1, {', '.join(_closed(q) for q in range(4))}
  FROM (SELECT r.conv_id, r.i, {', '.join(f'{_step(q)} AS w{q}' for q in range(4))} FROM r JOIN p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
     LEFT JOIN (SELECT * FROM r WHERE i = 0) r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
