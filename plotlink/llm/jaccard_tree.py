"""N-gram Jaccard join by signature trees.

Equal shingle sets are one node. Documents that have enough shingles to themselves link with none and
are settled first. A prefix of each other set, rarest shingles first, is its list of keys: two
sets that are similar enough share several, so the graph of sets that meet on as many (or on a key of
many sets) has every link within one of its components. A component is a block. In a block a signature tree is built: leaves are sets with a
token bitmap and a size, inner nodes the OR of bitmaps and the range of sizes; a dual traversal
skips pairs of nodes whose maximum possible overlap is too small, and pairs already connected, and
verifies the rest exactly. A block of more shingles than a task should hold is cut into chunks: each
chunk is joined with itself and the block's pivots first, and only where that leaves a block in
several parts are its chunks joined pair by pair. The corpus-wide shingle counts only order the
prefix; any order gives the same links.

Defined cases: a text without words has an empty set and links with nothing; rows are judged by
their sets, so repeated rows share a class, and sets with the same smallest doc_id count as one
document; a null doc_id takes part under the smallest number and stays null in the result; an empty
table gives no rows."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm.common import as_long, by_group, id_and_text, mixed, pages, shingle_set, words_of, written
from plotlink.llm.components import components

_NULL_ID, _SHARED = -(1 << 63), -(1 << 63) + 1
#: Shingles counted at a time; those seen this often in one go are reported; at most so many are ranked.
COUNTED, SEEN, RANKED = 1 << 21, 4, 1 << 16
BITS, LEAF, FAN = 4096, 4, 4
#: A key of at most so many sets is met pair by pair; a pair must meet on one key for every so many shingles, and on at most so many.
FEW_SETS, PER_KEY, MOST_KEYS = 16, 16, 16


def sets_of(texts, k: int, lower: bool = True) -> list:
    """Shingle sets of texts; A-Z in lower case."""
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass")
        out.append(shingle_set((words.lower() if lower else words).split(), k))
    return out


def common_shingles(docs: DataFrame, k: int) -> DataFrame:
    """The most frequent shingles with counts, from all documents; only orders prefixes."""
    def run(frames):
        held, n = [], 0

        def counted():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= SEEN
            return pd.DataFrame({"shingle": as_long(values[some]), "n": times[some].astype(np.int64)})

        for pdf in pages(frames):
            held += sets_of(pdf["text"], k)
            n = sum(map(len, held))
            if n >= COUNTED:
                yield counted()
                held = []
        if n and held:
            yield counted()

    return docs.mapInPandas(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(RANKED)


def needed(total: int, num: int, den: int) -> int:
    """Least overlap of two sets of together ``total`` shingles at similarity num/den."""
    return -(-num * total // (num + den))


def prefixes(docs: DataFrame, k: int, num: int, den: int, ranks) -> DataFrame:
    """node, n and the prefix of its set: so long that two similar sets share ``_keys_met`` of it, not one alone."""
    def run(frames):
        values, place = ranks.value
        for pdf in pages(frames):
            rows = []
            for doc, s in zip(pdf["doc_id"], sets_of(pdf["text"], k)):
                n = len(s)
                most = max(1, min(int(1.01 * n * den / num / PER_KEY), MOST_KEYS))  # as many as the next class asks for, or more
                order = np.zeros(n, np.int64)
                if len(values) and n:
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    order = np.where(values[at] == s, place[at], 0)
                rows.append((doc, n, as_long(s[np.lexsort((mixed(s), order))[:n - -(-num * n // den) + most]])))
            yield pd.DataFrame(rows, columns=["node", "n", "prefix"])

    return docs.mapInPandas(run, "node long, n int, prefix array<long>")


class Tree:
    """Arrays of nodes by level, the leaves first; sets are ordered by size, then smallest hashes,
    so that similar ones are near each other."""

    def __init__(self, sets: list, order: np.ndarray):
        self.order = order
        words = BITS // 64
        bits = np.zeros((len(order), words), np.uint64)
        for i, j in enumerate(order):
            cell = (mixed(sets[j]) >> np.uint64(40)).astype(np.int64) % BITS
            np.bitwise_or.at(bits[i], cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
        size = np.array([len(sets[j]) for j in order])
        # shingles that share a bit with another of their set: they may overlap unseen
        extra = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, size, size, extra)]
        for fan in (LEAF, *[FAN] * 40):
            b, lo, hi, ex = self.levels[-1]
            if len(b) == 1:
                break
            at = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def tree_links(sets: list, num: int, den: int, left=None, right=None, label=None) -> list:
    """Links (i, j) that connect whatever is similar among ``sets``, or between the positions in
    ``left`` and ``right``; pairs that others, or an equal ``label``, already connect are skipped."""
    first = {}
    parent = list(range(len(sets))) if label is None else [first.setdefault(x, i) for i, x in enumerate(label)]

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def ordered(at):
        keys = [(len(sets[i]), int(mixed(sets[i]).min())) for i in at]
        return np.array([i for _, i in sorted(zip(keys, at))], np.int64)

    both = left is None
    a = Tree(sets, ordered(range(len(sets)) if both else left))
    b = a if both else Tree(sets, ordered(right))
    links, stack = [], [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        (ba, loa, hia, xa), (bb, lob, hib, xb) = a.levels[la], b.levels[lb]
        if den * hia[i] < num * lob[j] or den * hib[j] < num * loa[i]:
            continue
        most = min(int(np.bitwise_count(ba[i] & bb[j]).sum()) + min(int(xa[i]), int(xb[j])), int(hia[i]), int(hib[j]))
        if most < needed(int(loa[i]) + int(lob[j]), num, den):
            continue
        if la == lb == 0:
            x, y = int(a.order[i]), int(b.order[j])
            if x != y and root(x) != root(y):
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if den * common >= num * (len(sets[x]) + len(sets[y]) - common):
                    links.append((x, y))
                    parent[root(x)] = root(y)
            continue
        ups = range(i * a.fan(la), min((i + 1) * a.fan(la), len(a.levels[la - 1][1]))) if la and (la >= lb) else [i]
        downs = range(j * b.fan(lb), min((j + 1) * b.fan(lb), len(b.levels[lb - 1][1]))) if lb and (lb >= la) else [j]
        na, nb = la - (la >= lb and la > 0), lb - (lb >= la and lb > 0)
        for p in ups:
            for q in downs:
                if not both or p <= q or na != nb:
                    stack.append((na, p, nb, q))
    return links


def _block_links(members: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Links (a, b) within groups (block, i, j) of members (node, label, side, text): all among side
    0, else side 1 with side 2."""
    key = ["block", "i", "j"]

    def run(frames):
        for pdf in by_group(frames, key):
            sets, side, label = sets_of(pdf["text"], k), pdf["side"].to_numpy(), pdf["label"].tolist()
            if (side == 0).any():
                found = tree_links(sets, num, den, label=label)
            else:
                left, right = np.flatnonzero(side == 1).tolist(), np.flatnonzero(side == 2).tolist()
                found = tree_links(sets, num, den, left, right, label) if left and right else []
            ids = pdf["node"].to_numpy()
            yield pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    return members.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def _size_class(num: int, den: int):
    """Sizes of a link differ by den/num at most, so by one class."""
    return F.floor(F.log("n") / math.log(1.0001 * den / num)).cast("int")


def _keys_met(num: int, den: int, size_class):
    """How many keys two similar sets of a class and the one below share at least."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_KEYS), F.floor(F.pow(F.lit(1.0001 * den / num), size_class) / PER_KEY).cast("int")))


def block_edges(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that hold any similar sets together: those who meet on enough keys that few sets have, and the sets of each
    key that many have. A shingle shared by chance or a passage holds no two sets together, so blocks don't grow into one
    another with the corpus."""
    own = _size_class(num, den)  # each set stands in its own and the next, where the larger of a link is
    keyed = nodes.withColumn("own", own).select("node", "own", F.explode("prefix").alias("key")).select("node", "own", F.explode(F.array("own", F.col("own") + 1)).alias("c"), "key") \
        .select("node", (F.col("own") == F.col("c")).alias("own"), "c", F.xxhash64("key", "c").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other"), (F.count("*") > FEW_SETS).alias("many")).filter("pivot < other").select("key", "pivot", "many")
    held = written(keyed.join(shared, "key"), "keys")
    many = held.filter("many and node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    few = held.filter("not many").select("key", "node", "own", "c")
    # of one class and the class below, so a pair meets in one class alone
    pairs = few.join(few.select("key", F.col("node").alias("other"), F.col("own").alias("others")), "key").filter("node > other and (own or others)") \
        .groupBy(F.col("node").alias("a"), F.col("other").alias("b"), "c").agg(F.count("*").alias("met"))
    return many.union(pairs.filter(F.col("met") >= _keys_met(num, den, F.col("c"))).select("a", "b"))


def _linked(base: DataFrame, nodes: DataFrame, blocks: DataFrame, num: int, den: int, k: int, chunk_shingles: int) -> DataFrame:
    """Links that connect whatever is similar within blocks (node, component). A large block's chunks
    lie within a size class, so only those of the same and the next class can hold links."""
    sized = blocks.join(nodes.select("node", "n"), "node").withColumn("class", _size_class(num, den))
    large = sized.groupBy("component").agg(F.sum("n").alias("n")).filter(F.col("n") > chunk_shingles).select("component", F.lit(True).alias("large"))
    parts = sized.groupBy("component", "class").agg(F.ceil(F.sum("n") / chunk_shingles).cast("long").alias("parts"), F.min("node").alias("pivot"))
    chunk = F.col("class").cast("long") * (1 << 40)
    rows = sized.join(large, "component", "left").join(parts, ["component", "class"]).select(
        "node", F.col("component").alias("block"), F.coalesce("large", F.lit(False)).alias("large"), "class", "parts", "pivot")
    placed = written(rows.withColumn("i", F.when(F.col("large"), chunk + F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(-1)), "placed")
    pivots = placed.filter("large and parts > 1 and node = pivot").select("node", "block", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")) \
        .select("node", "block", (F.col("c") + F.col("p")).alias("i"))
    alone = placed.select("node", "block", "i").union(pivots).distinct() \
        .select("node", "block", "i", F.lit(-1).alias("j"), F.lit(0).alias("side"), F.col("node").alias("label"))
    texts = lambda members: base.join(members, F.col("doc_id") == F.col("node")).drop("doc_id")
    links = written(_block_links(texts(alone), num, den, k), "links")
    split = placed.filter("large")
    if split.isEmpty():
        return links
    labels = split.join(components(links), "node", "left").select("node", "block", "class", "i", F.coalesce("component", "node").alias("label"))
    open_ = labels.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("block")
    chunks = split.select("block", "class", F.col("i").alias("x")).distinct()
    near = labels.join(open_, "block").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    pairs = near.join(chunks, ["block", "class"]).filter("x <> i").select(
        "node", "block", F.least("i", "x").alias("lo"), F.greatest("i", "x").alias("hi"), F.when(F.col("i") < F.col("x"), 1).otherwise(2).alias("side"), "label")
    more = _block_links(texts(pairs.withColumnsRenamed({"lo": "i", "hi": "j"})), num, den, k)
    return links.union(written(more, "links"))


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, two hashes and the size of each document's shingle set."""
    def run(frames):
        for pdf in pages(frames):
            sets = sets_of(pdf["text"], k)
            with np.errstate(over="ignore"):
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "s1": [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets],
                                    "s2": [int(mixed(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets], "n": [len(s) for s in sets]})

    return docs.mapInPandas(run, "doc_id long, s1 long, s2 long, n int")


def _own_shingles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, own: how many of the shingles with a hash in the first quarter no other document has.
    A task sends each hash once, so one that very many documents hold is a few rows."""
    def run(frames):
        held, ids, n = [], [], 0

        def told():
            values, first, times = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            return pd.DataFrame({"shingle": as_long(values), "holder": np.where(times == 1, np.concatenate(ids)[first], _SHARED)})

        for pdf in pages(frames):
            for doc, s in zip(pdf["doc_id"], sets_of(pdf["text"], k)):
                s = s[(mixed(s) >> np.uint64(62)) == 0]
                held.append(s)
                ids.append(np.full(len(s), doc, np.int64))
                n += len(s)
            if n >= COUNTED:
                yield told()
                held, ids, n = [], [], 0
        if n:
            yield told()

    met = docs.mapInPandas(run, "shingle long, holder long").repartition("shingle").groupBy("shingle").agg(F.min("holder").alias("holder"), F.max("holder").alias("other"), F.count("*").alias("times"))
    return met.filter((F.col("times") == 1) & (F.col("holder") != _SHARED)).groupBy(F.col("holder").alias("owner")).agg(F.count("*").alias("own"))


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                 chunk_shingles: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links. Two documents
    link when ``den * |intersection| >= num * |union|`` over sets of k-word shingles.

    First, documents with more shingles of their own than a link would leave them are settled: they
    link with none. (Their prefix, own shingles first, has no key that another document has.)"""
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text")
    known = written(_sizes(base, k), "sizes")
    classes = written(known.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node")), "classes")
    spare = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")
    maybe = known.join(classes, ["s1", "s2", "n"]).filter("doc_id = node").join(_own_shingles(base, k), F.col("node") == F.col("owner"), "left") \
        .filter(F.coalesce("own", F.lit(0)) < spare).select("node").distinct()
    few = written(base.join(maybe, F.col("doc_id") == F.col("node")).select("doc_id", "text"), "texts")
    top = common_shingles(few, k).collect()  # RANKED rows at most
    values = np.array([r["shingle"] for r in top], np.int64).view(np.uint64)
    at, place = np.argsort(values), np.arange(len(top), 0, -1)  # the rarest first
    ranks = spark.sparkContext.broadcast((values[at], place[at]))
    nodes = written(prefixes(few, k, num, den, ranks), "prefixes")
    blocks = written(components(block_edges(nodes, num, den)), "blocks")
    links = _linked(few, nodes, blocks, num, den, k, chunk_shingles)
    class_of = components(links)
    grouped = classes.join(class_of, "node", "left").select("s1", "s2", "n", F.coalesce("component", "node").alias("component_id"))
    null_id = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return known.join(grouped, ["s1", "s2", "n"], "left").select(
        null_id("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).select(
        "doc_id", "n_shingles", null_id("component_id"))
