"""The prefix-tree join against all pairs."""

import random
from fractions import Fraction

import numpy as np

from lexmill.llm import jaccard
from tests_data import EDGE_ROWS, EDGE_SCHEMA


def brute_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = [brute_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    low: dict = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows))


def near_copies(rnd, groups, copies):
    rows = []
    for _ in range(groups):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(3, 120))]
        for _ in range(rnd.randrange(1, copies)):
            own = list(words)
            for _ in range(rnd.randrange(0, 4)):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
            rows.append(own)
    hot = [f"h{i}" for i in range(60)]
    rows += [hot + [f"y{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 40))] for _ in range(40)]
    rnd.shuffle(rows)
    return [(i * 3 + 1, " ".join(r)) for i, r in enumerate(rows)]


def test_tree_links_connect_what_all_pairs_connect():
    rnd = random.Random(1)
    for _ in range(200):
        sets = [np.unique(np.array([rnd.randrange(40) for _ in range(rnd.randrange(1, 30))], "u8")) for _ in range(rnd.randrange(1, 40))]
        sets += [np.unique(np.concatenate([s, np.array([rnd.randrange(60)], "u8")])) for s in sets[:15]]
        sets = [np.frombuffer(b, "u8") for b in {s.tobytes() for s in sets}]
        t = Fraction(rnd.choice([50, 60, 80, 90]), 100)
        links = jaccard.tree_links(sets, list(range(len(sets))), t)

        def closed(pairs):
            p = list(range(len(sets)))

            def find(k):
                while p[k] != k:
                    k = p[k]
                return k

            for i, j in pairs:
                p[find(i)] = find(j)
            return len({find(k) for k in p}), [[find(i) == find(j) for j in range(len(sets))] for i in range(len(sets))]

        real = [(i, j) for i in range(len(sets)) for j in range(i) if (o := len(np.intersect1d(sets[i], sets[j]))) * t.denominator >= t.numerator * (len(sets[i]) + len(sets[j]) - o)]
        assert set(map(frozenset, links)) <= set(map(frozenset, real))
        assert closed(links) == closed(real)


def test_components_equal_all_pairs(spark):
    rows = near_copies(random.Random(2), 30, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    plain = jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, plain.collect())) == want
    blocks = jaccard.jaccard_components(docs, block_numbers=300, block_sets=3, hot_shingles=20).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, blocks.collect())) == want
    kept = sorted(r[0] for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted({c for _, _, c in want})


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA)
    got = sorted(map(tuple, jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components([(r[0], r[1]) for r in EDGE_ROWS])
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == [-11, 1, 2, 3, 4, 5, 6, 7, 10, 12]


def test_one_row_of_each_component_stays(spark):
    body = " ".join(f"w{i}" for i in range(60))
    near = body + " more"
    rows = [(1, body), (2, near), (2, "something else entirely that no other text has"), (None, near), (None, "alone without an id"), (3, body), (1, body), (4, None), (4, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, body), (2, "something else entirely that no other text has"), (None, "alone without an id"), (4, None), (4, "")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_ties_hold_every_link(spark):
    """Common passages in texts of one's own, and sizes near the threshold's ratio: no link may fall between clusters."""
    rnd = random.Random(4)
    passages = [[f"p{k}_{i}" for i in range(rnd.randrange(10, 40))] for k in range(4)]
    rows = []
    for _ in range(160):
        own = [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 25))]
        rows.append([w for p in rnd.sample(passages, rnd.randrange(1, 4)) for w in p] + own)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, hot_shingles=30).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_connected_components(spark):
    from lexmill.llm.common import connected_components

    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, k) for k in range(201, 260)] + [(300, 300)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(70)]
    parent = {n: n for e in edges for n in e}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert set(got) == set(parent)
    assert len({(got[n], find(n)) for n in parent}) == len({find(n) for n in parent}) == len(set(got.values()))
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ties_need_places_that_leave_enough(spark):
    """Sets that share what stands too late in the smaller one's prefix can't link, and aren't tied; what links is."""
    t = Fraction(80, 100)

    def ties(sets):
        rows = []
        for c, s in enumerate(sets):
            head = s[: jaccard.prefix_length(len(s), t)]
            rows += [(x, len(s) * jaccard.PLACES + i * jaccard.PLACES // len(head), c) for i, x in enumerate(head)]
        return {frozenset(r) for r in jaccard.candidate_ties(spark.createDataFrame(rows, "number long, size long, class_id long"), t).collect()}

    # at these sizes a link needs all of the smaller set, so also its first number
    x = 10**6
    small = [[*range(1000 * k, 1000 * k + 10), x, *range(2 * x + 100 * k, 2 * x + 100 * k + 69)] for k in range(8)]
    large = [[x, *range(10 * x + 1000 * k, 10 * x + 1000 * k + 99)] for k in range(8)]
    assert ties([small[0], large[0]]) == set()
    assert ties(small + large) == set()
    assert ties([small[0], sorted([*small[0], *range(5 * x, 5 * x + 20)])]) == {frozenset((0, 1))}
    rnd = random.Random(7)
    sets = [sorted(rnd.sample(range(80), rnd.randrange(1, 50))) for _ in range(60)]
    sets += [sorted({*s[rnd.randrange(2) :], *rnd.sample(range(80, 90), rnd.randrange(3))} or {1}) for s in sets for _ in range(2)]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in map(sorted, (p for p in ties(sets) if len(p) == 2)):
        parent[find(i)] = find(j)
    real = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})]
    assert len(real) > 40
    # equal sets are one class; here they are ties like others
    assert all(find(i) == find(j) for i, j in real)


def test_sets_are_chosen_without_a_shuffle_of_texts(spark, monkeypatch):
    """The table of asked-for documents lets some pass by chance; nothing changes, and no text is joined."""
    monkeypatch.setattr(jaccard, "TABLE_BITS", 64)
    rows = near_copies(random.Random(5), 20, 8)
    docs = spark.createDataFrame([*rows, (None, "an id that is null beside " * 9), (None, "an id that is null beside " * 9 + "it")], "doc_id long, text string")
    got = jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").where("doc_id IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_a_class_that_many_tasks_sent_is_one_holder(spark):
    """Copies dealt over many tasks tie nothing more than one of them does."""
    t = Fraction(80, 100)
    rnd = random.Random(11)
    sets = [sorted(rnd.sample(range(60), rnd.randrange(5, 40))) for _ in range(30)]
    rows = []
    for c, s in enumerate(sets):
        head = s[: jaccard.prefix_length(len(s), t)]
        rows += [(x if x % 7 else x - 2**63, len(s) * jaccard.PLACES + i * jaccard.PLACES // len(head), c) for i, x in enumerate(head)]
    ties = lambda rows: sorted(map(tuple, jaccard.candidate_ties(spark.createDataFrame(rows, "number long, size long, class_id long"), t).collect()))
    once = ties(rows)
    assert once and ties(rows * 9) == once
    alone = [(x, 40 * jaccard.PLACES + x, 1) for x in range(8)]
    assert ties(alone * 9) == []


def test_rounds_of_components_take_few_tasks(spark, monkeypatch):
    """Small tables dealt over many partitions don't leave files for each of them in every round."""
    from lexmill.llm import common

    tasks, checkpointed, written = [], common.checkpointed, common.written
    monkeypatch.setattr(common, "checkpointed", lambda df: tasks.append((x := checkpointed(df)).rdd.getNumPartitions()) or x)
    monkeypatch.setattr(common, "written", lambda df: tasks.append(df.rdd.getNumPartitions()) or written(df))
    monkeypatch.setattr(common, "ROUND_ROWS", 100)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(150)], "src long, dst long").repartition(40)
        got = common.connected_components(edges).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 151 and len({r["component"] for r in got}) == 1
    assert len(tasks) > 4 and max(tasks) <= 4
