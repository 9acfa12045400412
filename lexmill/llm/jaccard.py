"""Exact Jaccard self-join on word shingles by prefix trees, and its components.

1. Each text becomes a set of 63-bit shingle numbers; equal sets are one class, so copies never meet in pairs.
2. Numbers are ordered globally: by value, but those of the most frequent shingles (a list of fixed size) come last, the
   most frequent at the very end. Any one order gives the same result; this one keeps common passages out of prefixes.
3. Sets with overlap enough for the threshold share, among the first n - ceil(t n) + 1 numbers of each, as many as what
   follows cannot make up for: of two sets of like size almost half of them. Where the rarest shared number has few
   holders, the pair is met there and weighed by the numbers it shares. Where it has many, all shared numbers have: then
   each of the two sets holds so many commoner numbers that the rarest is no common passage beside a text of its own. Only
   such holders, of sizes that may link, are tied together at a number. Classes so tied form a cluster; no link leaves it.
4. In a cluster the ordered sets are stored in a prefix tree, and each is carried down it: sets with a common start share
   the overlap counted so far; a subtree is left when even all remaining numbers could not make the overlap, or when all
   its sets are in one component with the carried set already. Large clusters are dealt out in blocks of bounded size.
"""

from __future__ import annotations

import bisect
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import BATCH_ROWS, checkpointed, connected_components, gathered, sized

WORDS = 5
THRESHOLD = Fraction(80, 100)
#: Shingles that are ordered last, by number of documents; a hint for speed, its size a bound on what is sent to tasks.
HOT_SHINGLES = 1 << 18
#: A shingle is counted for that list where this many of the documents held at once by a task hold it.
HOT_IN_BATCH = 2
#: Shingle numbers that a task holds at once, and classes it remembers to have sent.
HELD_NUMBERS, HELD_CLASSES = 600_000, 100_000
#: Shared numbers with at most so many holders are met pair by pair.
FEW_HOLDERS = 6
#: Steps in which a number's place in a prefix is told.
PLACES = 256
#: Bands of set sizes in a factor of 1 / threshold.
BANDS = 10
#: Bits of the table that tells, but for chance, which documents' sets are asked for.
TABLE_BITS = 1 << 25
#: Numbers and sets of a block of a large cluster.
BLOCK_NUMBERS, BLOCK_SETS = 500_000, 1_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], "u8")
_TOP = np.uint64(1) << np.uint64(63)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle numbers (below 2^63) of a UTF-8 text; none without words.

    Words are parted by ASCII white space and A-Z lower-cased; with fewer words, the whole sequence is one shingle.
    """
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, "u8")
    h = np.fromiter(map(_words.__getitem__, parts), "u8", len(parts))
    k = min(words, len(parts))
    total = np.full(len(h) - k + 1, k, "u8")
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _MULTIPLIERS[i % 7] + np.uint64(i // 7)
        if words > 7:
            total ^= total >> np.uint64(31)
    total = (total ^ (total >> np.uint64(32))) * _MULTIPLIERS[5]
    total ^= total >> np.uint64(29)
    total = np.sort(total >> np.uint64(1))
    keep = np.ones(len(total), bool)
    keep[1:] = total[1:] != total[:-1]
    return total[keep]


def class_id(numbers: np.ndarray, seed: int = 0) -> int:
    """A set's class: 63 bits of a hash of its numbers."""
    return xxhash.xxh3_64_intdigest(numbers.tobytes(), seed=seed) >> 1


class Order:
    """The global order: a number keeps its value, one on the list gets 2^63 and its place there."""

    def __init__(self, hot: np.ndarray):
        by = np.argsort(hot)
        self.hot, self.place = hot[by], by.astype("u8") | _TOP

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.hot) or not len(numbers):
            return numbers
        at = np.minimum(np.searchsorted(self.hot, numbers), len(self.hot) - 1)
        known = self.hot[at] == numbers
        return np.sort(np.where(known, self.place[at], numbers)) if known.any() else numbers


def prefix_length(n: int, t: Fraction = THRESHOLD) -> int:
    return n - math.ceil(t * n) + 1


class PrefixTree:
    """Ordered sets in a prefix tree with joined edges; sets are numbered in the order of their sequences.

    Nodes are parallel lists: first and last set below, depth of the edge's end, children; ``edges`` holds a node's
    numbers. ``one`` is a set of the node's only component, once it is known to have one.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = [len(s) for s in sets]
        self.lo, self.hi, self.depth, self.children, self.edges, self.one, self.least, self.most, self.leaf = [], [], [], [], [], [], [], [], []
        common = [0] * (len(sets) + 1)
        for i in range(1, len(sets)):
            a, b = sets[i - 1], sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common[i] = int(differ[0]) if len(differ) else m
        self.common = common
        self.root = self._node(0, len(sets), 0)

    def _node(self, lo: int, hi: int, above: int) -> int:
        """Nodes of sets lo .. hi-1, which share their first ``above`` numbers; without recursion."""
        root = None
        todo = [(lo, hi, above, None)]
        while todo:
            lo, hi, above, parent = todo.pop()
            depth = min(self.common[lo + 1 : hi], default=self.size[lo]) if parent is not None else 0
            depth = min(depth, self.size[lo])
            k = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.depth.append(depth)
            self.edges.append(self.sets[lo][above:depth])
            self.children.append([])
            self.one.append(lo if hi - lo == 1 else None)
            self.least.append(min(self.size[lo:hi]))
            self.most.append(max(self.size[lo:hi]))
            if parent is None:
                root = k
            else:
                self.children[parent].append(k)
            ended = lo
            while ended < hi and self.size[ended] == depth:
                ended += 1
            self.leaf.append(ended)  # sets lo .. ended-1 end here
            at = ended
            while at < hi:
                to = at + 1
                while to < hi and self.common[to] > depth:
                    to += 1
                todo.append((at, to, depth, k))
                at = to
        return root


def tree_links(sets: list[np.ndarray], component: list[int], t: Fraction = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect what the threshold connects: (i, j) index pairs into ``sets``, a spanning forest.

    ``component`` names components known before (equal numbers: connected). Pairs inside one component aren't looked
    at. A set is carried down only towards sets that share a number of its prefix and whose size allows a link.
    """
    by = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    tree = PrefixTree([sets[i] for i in by])
    parent = list(range(len(by)))
    first: dict[int, int] = {}
    for k, i in enumerate(by):
        parent[k] = first.setdefault(component[i], k)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    num, den = t.numerator, t.numerator + t.denominator  # overlap o of sizes a and b is enough if den * o >= num * (a + b)
    lo_, hi_, depth_, children_, edges_, one_, least_, most_, leaf_ = tree.lo, tree.hi, tree.depth, tree.children, tree.edges, tree.one, tree.least, tree.most, tree.leaf

    def carry(x: int, own: list[int], held: set[int], wanted: list[int]) -> None:
        """Takes set x down the tree to those of the ``wanted`` sets, all before x, that it may link to."""
        n = len(own)
        todo = [(tree.root, 0)]  # (node, overlap of the path above)
        while todo:
            node, m = todo.pop()
            at = bisect.bisect_left(wanted, lo_[node])
            if at == len(wanted) or wanted[at] >= hi_[node]:
                continue
            if one_[node] is not None and find(one_[node]) == find(x):
                continue
            edge, depth = edges_[node].tolist(), depth_[node]
            m += len(held.intersection(edge))
            rest = n - bisect.bisect_right(own, edge[-1]) if edge else n
            best = min(max(rest + depth, least_[node]), most_[node])  # the size for which the bound is weakest
            if den * (m + min(rest, best - depth)) < num * (n + best):
                continue
            for y in range(lo_[node], min(leaf_[node], x)):
                if den * m >= num * (n + depth) and find(y) != find(x):
                    links.append((by[x], by[y]))
                    parent[find(y)] = find(x)
            todo += [(c, m) for c in children_[node]]

    # numbers that stand in two prefixes at least; the sets met so far that hold each, and whether they are connected
    heads = [s[: prefix_length(len(s), t)] for s in tree.sets]
    u, times = np.unique(np.concatenate(heads), return_counts=True)
    shared = u[times > 1]
    holders: dict[int, list[int]] = {}
    united: dict[int, bool] = {}
    for x, head in enumerate(heads):
        own = tree.sets[x].tolist()
        held, n, met = set(own), len(own), set()
        keys = head[shared[np.minimum(np.searchsorted(shared, head), len(shared) - 1)] == head].tolist() if len(shared) else []
        for key in keys:
            others = holders.get(key)
            if not others or united[key] and find(others[0]) == find(x):
                continue
            wanted = [y for y in others if y not in met and t.denominator * min(n, tree.size[y]) >= t.numerator * max(n, tree.size[y])]
            if wanted:
                met.update(wanted)
                carry(x, own, held, wanted)
        for key in keys:
            others = holders.setdefault(key, [])
            united[key] = not others or united[key] and find(others[-1]) == find(x)
            others.append(x)
        _settle(tree, find, x)
    return links


def _settle(tree: PrefixTree, find, x: int) -> None:
    """Marks the nodes that end with set x, from the deepest up, as long as they have one component."""
    path, node = [], tree.root
    while True:
        path.append(node)
        node = next((c for c in tree.children[node] if tree.lo[c] <= x < tree.hi[c]), None)
        if node is None:
            break
    for node in reversed(path):
        if tree.one[node] is None:
            parts = [*range(tree.lo[node], tree.leaf[node]), *(tree.one[c] for c in tree.children[node] if tree.lo[c] <= x)]
            if None in parts or len({find(p) for p in parts if p <= x}) > 1 or tree.hi[node] > x + 1:
                break
            tree.one[node] = tree.lo[node]


def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, hot_shingles: int = HOT_SHINGLES, block_numbers: int = BLOCK_NUMBERS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id (and text_hash, group) of every row; component_id is the smallest doc_id reachable by links.

    Texts without words (null, empty) have no shingles and are alone; equal texts are one class; repeated rows are
    returned each; ids that occur with several texts name each row's own component; an empty table gives no rows.
    Only doc_id and text are read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))

    # 1. classes, and the frequent shingles of every batch
    def held(batches, column: int):
        """Texts of a batch in runs of bounded size: (slice of the batch, sets in the slice's order)."""
        for batch in batches:
            at, sets, n = 0, [], 0
            for k, text in enumerate(batch.column(column)):
                sets.append(shingles(text.as_py(), words))
                n += len(sets[-1])
                if n >= HELD_NUMBERS or k + 1 == batch.num_rows:
                    yield batch.slice(at, k + 1 - at), sets
                    at, sets, n = k + 1, [], 0

    names = ["kind", "doc_id", "n_shingles", "class_id", "twin", "text_hash"]

    def classify(batches):
        for batch, sets in held(batches, 1):
            cls = [class_id(s) if len(s) else None for s in sets]
            twin = [class_id(s, 1) for s in sets]
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(twin, pa.int64()), batch.column(2)], names=names)
            once = list({c: s for c, s in zip(cls, sets, strict=True) if c is not None}.values())
            if once:
                u, n = np.unique(np.concatenate(once), return_counts=True)
                often = n >= HOT_IN_BATCH
                u, n = u[often].astype("i8"), n[often].astype("i8")
                nothing = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), "i4")), nothing, pa.array(n), pa.array(u), nothing, nothing], names=names)

    both = checkpointed(base.mapInArrow(classify, "kind int, doc_id long, n_shingles long, class_id long, twin long, text_hash long"), BATCH_ROWS)
    rows = both.where("kind = 0").drop("kind")
    hot = both.where("kind = 1").groupBy("class_id").agg(F.sum("n_shingles").alias("n")).orderBy(F.desc("n"), "class_id").limit(hot_shingles).collect()
    order = Order(np.array([r[0] for r in reversed(hot)], "u8"))
    # different sets of one hash: none below a billion sets, a few at 10^11; they are named by their second hash
    clash = rows.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b").select("class_id")
    clashes = frozenset(r[0] for r in clash.collect())
    if clashes:
        rows = rows.join(F.broadcast(clash.withColumn("clash", F.lit(True))), "class_id", "left").withColumn("class_id", F.when(F.col("clash"), F.col("twin")).otherwise(F.col("class_id"))).drop("clash")
    rows = rows.select("doc_id", "n_shingles", "class_id", "text_hash")
    classes = checkpointed(rows.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n")))

    def named(sets: list[np.ndarray]) -> dict[int, np.ndarray]:
        """The sets that aren't empty, each once, by class."""
        return {class_id(s, 1) if c in clashes else c: s for c, s in ((class_id(s), s) for s in sets if len(s))}

    # 2. numbers of prefixes; a task sends a class once, as long as it remembers it
    def prefixes(batches):
        sent: set[int] = set()
        for _, sets in held(batches, 0):
            once = {c: s for c, s in named(sets).items() if c not in sent}
            if len(sent) > HELD_CLASSES:
                sent.clear()
            sent.update(once)
            if once:
                keys = [order(s)[: prefix_length(len(s), threshold)] for s in once.values()]
                size = np.concatenate([len(s) * PLACES + np.arange(len(k)) * PLACES // len(k) for s, k in zip(once.values(), keys, strict=True)])
                cls = np.repeat(np.array(list(once), "i8"), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype("i8")), pa.array(size), pa.array(cls)], names=["number", "size", "class_id"])

    found = base.where("text IS NOT NULL").select("text").mapInArrow(prefixes, "number long, size long, class_id long")
    edges = checkpointed(candidate_ties(found, threshold))
    clusters = connected_components(edges, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("cluster"))
    clusters = gathered(checkpointed(classes.join(sized(checkpointed(clusters)), "class_id")))

    # 3. sets of clustered classes, one of each
    known = clusters.select("class_id", "cluster", "n", F.col("low").alias("doc_id"))

    def ordered(batches):
        for _, sets in held(batches, 0):
            once = named(sets)
            if once:
                yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.int64()), pa.array([order(s).tobytes() for s in once.values()], pa.binary())], names=["class_id", "numbers"])

    sizes = known.groupBy("cluster").agg(F.sum("n").alias("numbers"), F.count("*").alias("sets"))
    parts = lambda numbers, sets: F.greatest(F.lit(1), F.ceil(F.col(numbers) / block_numbers), F.ceil(F.col(sets) / block_sets)).cast("int")
    sizes = sized(checkpointed(sizes.select("cluster", parts("numbers", "sets").alias("blocks"))))
    member = checkpointed(known.join(sizes, "cluster").select("class_id", "doc_id", "n", "cluster", "blocks", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("block")))

    def sets_of(members: DataFrame) -> DataFrame:
        # texts are chosen by a bit table of fixed size, so that none is shuffled; sets that pass it by chance are not members
        place = F.pmod(F.xxhash64("doc_id"), F.lit(TABLE_BITS))
        bits = members.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(TABLE_BITS >> 6, "i8")
        table[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()

        def asked(batches):
            for batch in batches:
                at = batch.column(1).to_numpy()
                yield from ordered([batch.filter(pa.array((table[at >> 6] >> (at & 63) & 1).astype(bool)))])

        texts = base.where("text IS NOT NULL").select("text", place.alias("place"))
        return texts.mapInArrow(asked, "class_id long, numbers binary").join(sized(members.drop("doc_id")), "class_id")

    # 4. links: inside blocks, between neighbouring blocks, then of all that is not in its cluster's largest component
    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class_id")
        ids = pdf["class_id"].tolist()
        links = tree_links([np.frombuffer(b, "u8") for b in pdf["numbers"]], pdf["component"].tolist(), threshold)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"], dtype="int64")

    def links_of(members: DataFrame, *key: str) -> DataFrame:
        return members.select("cluster", *key, "class_id", "numbers", "component").groupBy("cluster", *key).applyInPandas(joined, "a long, b long")

    # clusters are many and mostly small: their tasks are dealt by hash of the cluster
    links = checkpointed(links_of(sets_of(member.where("blocks = 1")).withColumn("component", F.col("class_id"))), BATCH_ROWS)
    if not member.where("blocks > 1").isEmpty():
        small, large = links, checkpointed(sets_of(member.where("blocks > 1")), BATCH_ROWS)
        links = checkpointed(links_of(large.withColumn("component", F.col("class_id")), "block"))

        def with_components(frame: DataFrame) -> DataFrame:
            alone = frame.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
            now = sized(checkpointed(connected_components(links.union(alone), "a", "b")))
            return frame.join(now, frame["class_id"] == now["node"]).drop("node")

        near = with_components(large).withColumn("group", F.explode(F.array_distinct(F.array("block", F.pmod(F.col("block") + 1, F.col("blocks"))))))
        links = checkpointed(links.union(links_of(near, "group")))
        now = with_components(large)
        weight = now.groupBy("cluster", "component").agg(F.count("*").alias("w"))
        largest = weight.groupBy("cluster").agg(F.max_by("component", F.struct("w", "component")).alias("largest"))
        now = now.join(sized(checkpointed(largest)), "cluster")
        minor = now.where("component <> largest")
        deals = checkpointed(minor.groupBy("cluster").agg(F.sum("n").alias("numbers"), F.count("*").alias("sets")).select("cluster", parts("numbers", "sets").alias("parts")))
        if not deals.isEmpty():
            # what is left over is dealt in parts of a block's size; each part meets each block once
            rest = minor.join(sized(deals), "cluster").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
            rest = rest.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            every = now.join(sized(deals), "cluster").withColumn("group", F.col("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cols = ["cluster", "group", "part", "class_id", "numbers", "component"]
            links = checkpointed(links.union(links_of(rest.select(cols).union(every.select(cols)), "group", "part")))
        links = small.union(links)

    # 5. components of classes, then of rows
    joint = connected_components(links, "a", "b")
    lowest = classes.join(joint, classes["class_id"] == joint["node"], "left").select("class_id", "low", F.coalesce("component", "class_id").alias("component"))
    lows = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    lowest = sized(checkpointed(lowest.join(lows, "component").select(F.col("class_id").alias("_class"), "component_id", F.col("component").alias("group"))))
    out = rows.join(lowest, F.col("class_id") == F.col("_class"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), "text_hash", "group")


def candidate_ties(found: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """a, b: ties of classes; whatever links by ``threshold`` is connected by them.

    ``found``: number, size, class_id of prefixes; size is a set's size n, and the number's place in the prefix in
    ``PLACES``-ths of its length, in one long. Of two sets of sizes n >= m with overlap o, the first o - t n + 1 shared
    numbers stand where the smaller set has t n numbers left at least, this one included (and the larger one too, by its
    prefix), or what follows couldn't make up the overlap. Only such places count below.

    A number of the list is below 0 here. Only it can have a large share of all holders; its tallies (a row each, as many
    as the list is long) are summed before the shuffle and broadcast, and its holders are never gathered.
    """
    t, num, den = float(threshold), threshold.numerator, threshold.denominator
    up = lambda x, d: F.floor((x + (d - 1)) / d)
    step = math.log(1 / t) / BANDS
    found = found.withColumn("n", F.shiftright("size", PLACES.bit_length() - 1))
    long = F.col("n") - up(num * F.col("n"), den) + 1  # the prefix
    found = found.withColumn("left", F.col("n") - up(F.pmod("size", F.lit(PLACES)) * long, PLACES))  # or somewhat more
    band = F.floor(F.log("n") / step).cast("int")
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))
    # a listed number's holders are dealt out; here they only pass through
    found = found.withColumn("salt", F.when(F.col("number") < 0, F.pmod(F.xxhash64("class_id"), F.lit(1 << 12))).otherwise(0))
    all_of = Window.partitionBy("number", "salt")
    own = all_of.orderBy("n", "class_id")
    # a class that several tasks sent is one holder
    found = found.withColumn("again", F.coalesce(F.lag("class_id").over(own) == F.col("class_id"), F.lit(False))).where("NOT again").drop("again")
    back = [F.struct(F.lag("class_id", k).over(own).alias("b"), F.lag("n", k).over(own).alias("m"), F.lag("left", k).over(own).alias("left")) for k in range(1, FEW_HOLDERS)]
    held = found.select("class_id", "n", "left", "number", F.count("*").over(all_of).alias("holders"), F.bit_or(bit(band)).over(all_of).alias("bands"), F.array(*back).alias("back")).where("holders > 1 OR number < 0")
    fits = lambda x: x["b"].isNotNull() & (x["left"] * den >= F.col("n") * num)
    few = (F.col("holders") <= FEW_HOLDERS) & (F.col("number") >= 0)
    met = F.transform(F.filter("back", fits), lambda x: F.struct(x["b"].alias("b"), x["m"].alias("m")))
    held = checkpointed(held.withColumn("back", F.when(few, met)).where("back IS NULL OR size(back) > 0"), BATCH_ROWS)
    plain, listed = held.where("number >= 0"), held.where("number < 0").select("class_id", "n", "left", "number")
    tally = listed.groupBy("number").agg(F.count("*").alias("holders"), F.bit_or(bit(band)).alias("bands"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").drop("lo", "hi")
    listed = listed.join(F.broadcast(checkpointed(tally)), "number").select("class_id", "n", "left", "number", "holders", "bands")
    common = plain.where("back IS NULL").drop("back").union(listed)

    # pairs at numbers of few holders, weighed by what they share there and at most share elsewhere
    pairs = plain.where("back IS NOT NULL").select(F.col("class_id").alias("a"), "n", F.inline("back"))
    # both orders of a pair of one size can't occur: rows are ordered by size, then class
    pairs = pairs.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.count("*").alias("c"))
    counts = sized(checkpointed(common.groupBy("class_id").count()))
    times = lambda side: counts.select(F.col("class_id").alias(side), F.col("count").alias(f"_{side}"))
    overlap = up(num * (F.col("n") + F.col("m")), num + den)
    after = F.greatest(up(num * F.col("n"), den), up(num * F.col("m"), den)) - 1  # what the numbers after a prefix can add
    most = F.col("c") + F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))
    pairs = pairs.join(times("a"), "a", "left").join(times("b"), "b", "left").where(most >= overlap - after).select("a", "b")

    # ties at numbers of many holders: beyond a number a set holds `more` commoner ones. A link to a set of size m needs
    # t (n + m) / (1 + t) - t max(n, m) shared numbers of prefixes at least; that is least at the end of a band of sizes
    # that lies farther from n. A larger set's size is t-th part of what this one has left at most
    more = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("holders"), F.desc("number"))) - 1
    need = lambda m: t / (1 + t) * (F.col("n") + m) - t * F.greatest(F.col("n").cast("double"), m)
    edge = lambda b: F.exp(b * F.lit(step))
    may = lambda b: (F.col("bands").bitwiseAND(bit(b)) != 0) & (F.least(need(edge(b) * (1 - 1e-9)), need(edge(b + 1) * (1 + 1e-9))) <= F.col("more") + 1 + 1e-6) & (t * edge(b) * (1 - 1e-9) <= F.col("left"))
    reach = F.filter(F.sequence(F.col("band") - (BANDS + 1), F.col("band") + BANDS + 1), may)
    common = common.withColumn("more", more).withColumn("band", band).select("class_id", "number", "band", F.explode(reach).alias("other"))
    keys = ["number", "low_band", "high_band"]
    common = checkpointed(common.select("class_id", "number", "band", F.least("band", "other").alias("low_band"), F.greatest("band", "other").alias("high_band")))
    centers = common.groupBy(*keys).agg(F.min("class_id").alias("b"), F.max("class_id").alias("_b"), F.min("band").alias("lo"), F.max("band").alias("hi"))
    centers = sized(checkpointed(centers.where("lo < hi OR low_band = high_band AND b < _b").select(*keys, "b")))
    stars = common.join(centers, keys).where("class_id <> b").select(F.col("class_id").alias("a"), "b")
    return pairs.union(stars).distinct()


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component one row stays, that with the smallest doc_id (null last), then text hash.

    So an id that stands on several texts loses only those that are copies, and rows without an id are judged like
    others. Of rows equal in id and text one stays; texts without words all stay.
    """
    found = checkpointed(jaccard_components(docs, **how).where("n_shingles > 0"))
    key = F.struct(F.isnull("doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"))
    stays = found.groupBy("group").agg(F.min(key).alias("stays"), F.count("*").alias("n")).where("n > 1").select("group", "stays.*")
    judged = found.join(sized(checkpointed(stays)), "group").withColumn("same", F.col("doc_id").eqNullSafe(F.col("b")) & (F.col("text_hash") == F.col("c")))
    judged = judged.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.first("same").alias("same"), F.count("*").alias("n"))
    judged = checkpointed(judged.where("NOT same OR n > 1"))
    # a row's columns travel in a struct, so their names can't clash with the keys'
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").cast("long").alias("_mine"), F.xxhash64(F.col("text").cast("string")).alias("_said"))
    mine = F.col("_mine").eqNullSafe(F.col("_id")) & (F.col("_said") == F.col("_hash"))
    kept = rows.join(sized(checkpointed(judged.where("NOT same").select("_id", "_hash"))), mine, "left_anti")
    twice = checkpointed(judged.where("same").select("_id", "_hash"))
    if not twice.isEmpty():
        kept = kept.join(sized(twice), mine, "left_anti").unionByName(kept.join(sized(twice), mine, "left_semi").dropDuplicates(["_mine", "_said"]))
    return kept.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
