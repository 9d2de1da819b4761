"""How five filters interact in every order they can be applied in.

Each document's failed filters are a mask. An order of the filters is a permutation; permutations
that begin alike are neighbours in lexicographic order, so every beginning of s letters is one interval
of (5 - s)! Lehmer ranks. For a mask, whether the s-th step removes, passes or finds it gone already
depends on those s letters alone: its count is added at the interval's start and taken off behind its end,
and a running sum over the 120 ranks gives every total. Documents are counted by mask once; orders
cost 120 x 5 rows for each part, however many documents there are.

Defined cases: a null text is empty, has no words and fails A alone, and E if an earlier id holds an empty
text too; a null part is the empty string; a row without an id counts, but is neither earlier nor later than
any other; rows that repeat an id with one text are all as early as each other; several labels of one id
count by their highest, labels without an id or document count for nothing; a part exists by its
documents, so an empty table gives no rows. Texts are equal where their SHA-256 and length are."""

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm.common import written

LETTERS = "ABCDE"
#: What a document counts for: itself, if of good quality, if toxic.
WEIGHTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A = 1, B = 2, C = 4, D = 8."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))


def flags(labels: DataFrame, id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row an id: whether any of its labels has quality 1, and toxic 1."""
    of = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(good) == 1, F.lit(False)).alias("g"), F.coalesce(F.col(toxic) == 1, F.lit(False)).alias("t"))
    return of.filter("doc_id is not null").groupBy("doc_id").agg(F.max("g").alias("good"), F.max("t").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, and the WEIGHTS of the documents with it. The text is read once and never shuffled: what
    travels is its digest. Copies meet as counts, one row a task, so a text that a third of all rows hold
    is no heavier than another."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.concat(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), F.encode(F.length(text).cast("string"), "UTF-8")).alias("same"), text_mask(text).alias("mask"))
    kind = ["same", "part", "mask", "good", "toxic"]
    named = rows.filter("doc_id is not null").join(flags(labels), "doc_id", "left").fillna(False, ["good", "toxic"]).groupBy("doc_id", *kind).agg(F.count("*").alias("c"))
    nameless = rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}).groupBy("doc_id", *kind).agg(F.count("*").alias("c"))
    groups = named.unionByName(nameless).groupBy(*kind).agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "c"))).alias("first"), F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))), F.lit(0)).alias("nameless"))
    # of one text there are at most four such rows a part
    groups = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("same")))
    passes = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    both = F.inline(F.array(F.struct(F.col("mask"), passes.alias("k")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passes).alias("k"))))
    split = groups.select("part", "good", "toxic", both).filter("k > 0")
    of = {"n": F.col("k"), "good": F.when(F.col("good"), F.col("k")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("k")).otherwise(0)}
    return split.groupBy("part", "mask").agg(*[F.sum(x).alias(w) for w, x in of.items()])


def intervals() -> list:
    """(mask, step, letter, what, first rank, rank behind the last) of every beginning of an order: ``what`` is
    removed, redundant, kept or unique."""
    out, size = [], len(LETTERS)
    orders = list(permutations(range(size)))  # in lexicographic order, so places are Lehmer ranks
    for step in range(1, size + 1):
        wide = factorial(size - step)
        for at in range(0, len(orders), wide):
            *before, last = orders[at][:step]
            for mask in range(1 << size):
                earlier, now = any(mask >> i & 1 for i in before), mask >> last & 1
                if not earlier:
                    out.append((mask, step, LETTERS[last], "removed" if now else "kept", at, at + wide))
                elif now:
                    out.append((mask, step, LETTERS[last], "redundant", at, at + wide))
                if mask == 1 << last:
                    out.append((mask, step, LETTERS[last], "unique", at, at + wide))
    return out


def audit(counts: DataFrame) -> DataFrame:
    """Totals by part, order and step, from ``masks``."""
    spark, counts = counts.sparkSession, written(counts, "masks")
    spans = spark.createDataFrame(intervals(), "mask int, step int, letter string, what string, lo int, hi int")
    ends = counts.join(F.broadcast(spans), "mask").select("part", "step", "what", *WEIGHTS, F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")))).alias("e"))
    names = {"kept": ("kept", "n"), "removed": ("removed", "n"), "redundant": ("redundant", "n"), "unique_fails": ("unique", "n"), "good_lost": ("removed", "good"), "toxic_lost": ("removed", "toxic")}
    deltas = ends.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(F.when(F.col("what") == what, F.col("e.sign") * F.col(w)).otherwise(0)).alias(name) for name, (what, w) in names.items()])
    orders = spark.createDataFrame([(r, "".join(p), s, p[s - 1]) for r, p in enumerate(permutations(LETTERS)) for s in range(1, len(LETTERS) + 1)],
                                   "rank int, filter_order string, step int, letter string")
    ranks = F.explode(F.sequence(F.lit(0), F.lit(factorial(len(LETTERS)) - 1))).alias("rank")
    grid = counts.select("part").distinct().select("part", ranks).join(F.broadcast(orders), "rank")  # 600 rows a part
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = grid.join(deltas, ["part", "step", "rank"], "left").withColumns({name: F.sum(F.coalesce(name, F.lit(0))).over(running) for name in names})
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return totals.select("part", "filter_order", "step", *[F.col(n).cast("long").alias(n) for n in names], shapley.cast("long").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(masks(docs, labels, id_col, text_col, part_col))
