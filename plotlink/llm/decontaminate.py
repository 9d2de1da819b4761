"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are put into partitions by the size of their shingle set. In a partition every item's sketch
is as many of its smallest hashes as must include one of any document that contains the wanted
share of it (what may be missing, and one more, at the partition's largest size): the search loses
nothing. A document is sketched for each partition: its shingle hashes that are not above the largest in the
partition's item sketches, so short items are found in documents of any length. Sketches that meet in a
partition make a candidate; only candidates are verified, by exact containment of shingles.

Defined cases: a text without words contains nothing; an item of under five words is one shingle, its
whole sequence, and is found wherever a document has it; an item without words matches nothing; repeated
rows of documents or items count once; items of one id, or without an id, whose texts differ stay
apart and give a row each, and so do documents; rows without an id take part with a null id; an empty
table on either side gives no rows. A-Z is compared in lower case."""

import hashlib
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm.common import BASE, as_long, id_and_text, mixed, pages, rolling, text_hash, without_rows, word_hashes, words_of, written
from plotlink.llm.jaccard_tree import sets_of

#: Bits of the filters that documents' shingles pass before they are joined with items'.
FILTER_BITS = 1 << 22
_NULL_ID = -(1 << 63)


def item_sketches(items: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """item_id, item (hash of the shingle set), n, part (power of two of the size), shingle, probe: whether it
    is in the sketch, short: its words if under k, else 0. Of items with one id and one set, one is given."""
    def run(frames):
        for pdf in pages(frames):
            rows = []
            for item, text, s in zip(pdf["doc_id"], pdf["text"], sets_of(pdf["text"], k)):
                if len(s):
                    words = len(words_of(text))
                    part = int(len(s) - 1).bit_length()
                    largest = 1 << part
                    take = min(len(s), largest - -(-num * largest // den) + 1)
                    sketch = np.argsort(mixed(s), kind="stable")[:take]
                    probe = np.zeros(len(s), bool)
                    probe[sketch] = True
                    rows.append(pd.DataFrame({"item_id": item, "item": hashlib.sha256(s.tobytes()).digest()[:16], "n": len(s), "part": part, "shingle": as_long(s), "probe": probe, "short": words if words < k else 0}))
            if rows:
                yield pd.concat(rows).astype({"item_id": "Int64"})

    return items.mapInPandas(run, "item_id long, item binary, n int, part int, shingle long, probe boolean, short int").distinct()


def _cells(h: np.ndarray, part: int = 0) -> np.ndarray:
    """Places in a filter of mixed hashes, for a partition (0: for all)."""
    return (mixed(h + np.uint64(int(part) * BASE % (1 << 64))) >> np.uint64(42)).astype(np.int64)


def nothing_known() -> dict:
    """What documents are compared with before any join: which shingles items have (``every``), which of them are
    in a partition's sketches (``probes``), each partition's largest sketch hash (``bounds``), and the lengths
    of items under k words (``short``). Of fixed size, whatever the items: two filters and 64 partitions."""
    return {"every": np.zeros(FILTER_BITS >> 3, np.uint8), "probes": np.zeros(FILTER_BITS >> 3, np.uint8), "bounds": {}, "short": set()}


def learn(own: dict, shingle, probe, part, short):
    h = mixed(shingle)
    for bits, at in ((own["every"], _cells(h)), *[(own["probes"], _cells(h[(part == p) & probe], p)) for p in np.unique(part)]):
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    for p in np.unique(part[probe]):
        own["bounds"][int(p)] = max(own["bounds"].get(int(p), 0), int(h[(part == p) & probe].max()))
    own["short"] |= set(np.unique(short[short > 0]).tolist())


def _known(sketches: DataFrame) -> dict:
    def run(frames):
        own = nothing_known()
        for pdf in frames:
            learn(own, pdf["shingle"].to_numpy().view(np.uint64), pdf["probe"].to_numpy(), pdf["part"].to_numpy(), pdf["short"].to_numpy())
        if own["bounds"]:
            yield pd.DataFrame({"known": [pickle.dumps(own)]})

    def merge(frames):
        own = nothing_known()
        for pdf in frames:
            for other in map(pickle.loads, pdf["known"]):
                own["every"] |= other["every"]
                own["probes"] |= other["probes"]
                own["short"] |= other["short"]
                for p, h in other["bounds"].items():
                    own["bounds"][p] = max(own["bounds"].get(p, 0), h)
        yield pd.DataFrame({"known": [pickle.dumps(own)]})

    return pickle.loads(sketches.select("shingle", "probe", "part", "short").mapInPandas(run, "known binary").coalesce(1).mapInPandas(merge, "known binary").first()[0])


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def shingles_of(text: str, k: int, short) -> np.ndarray:
    """A document's shingles: of k words, and of the lengths of shorter items."""
    base = sets_of([text], k)[0]
    if not short or not len(base):
        return base
    h = word_hashes([w.lower() for w in words_of(text)])
    return np.unique(np.concatenate([base, *[rolling(h, n, BASE + 2 * n) for n in sorted(short)]]))


def doc_hits(docs: DataFrame, k: int, known) -> DataFrame:
    """doc_id, same, shingle, parts: shingles that may be an item's, and in which partitions' sketches of the
    document they are."""
    def run(frames):
        own = known.value
        for pdf in pages(frames):
            out = []
            for doc, same, text in zip(pdf["doc_id"], pdf["same"], pdf["text"]):
                s = shingles_of(text, k, own["short"])
                h = mixed(s)
                some = has(own["every"], _cells(h))
                if some.any():
                    s, h = s[some], h[some]
                    of = [(p, (h <= np.uint64(top)) & has(own["probes"], _cells(h, p))) for p, top in own["bounds"].items()]
                    out.append(pd.DataFrame({"doc_id": doc, "same": same, "shingle": as_long(s), "parts": [[p for p, yes in of if yes[i]] for i in range(len(s))]}))
            if out:
                yield pd.concat(out)

    return docs.mapInPandas(run, "doc_id long, same long, shingle long, parts array<int>")


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, same (hash of the text), item_id, n_shared, n_item: documents with at least num/den of an item's
    shingles. What meets in a partition are sketches; the exact count goes over candidates alone."""
    spark = docs.sparkSession
    sketches = written(item_sketches(id_and_text(items, item_col, item_text), k, num, den), "items")
    if sketches.isEmpty():
        return spark.createDataFrame([], "doc_id long, same long, item_id long, item binary, n_shared long, n_item long")
    known = spark.sparkContext.broadcast(_known(sketches))
    base = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text", text_hash(F.col("text")).alias("same"))
    hits = written(doc_hits(base, k, known).dropDuplicates(["doc_id", "same", "shingle"]), "hits")
    probes = sketches.filter("probe").select("part", "shingle", "item_id", "item", "n")
    pairs = hits.select("doc_id", "same", "shingle", F.explode("parts").alias("part")).join(probes, ["part", "shingle"]).select("doc_id", "same", "item_id", "item", "n").distinct()
    # an item's set goes to its candidates, and what of it their documents have is counted; equal sets share one
    sets = sketches.select("item", "shingle").distinct()
    shared = pairs.select("doc_id", "same", "item").distinct().join(sets, "item").join(hits.select("doc_id", "same", "shingle"), ["doc_id", "same", "shingle"]) \
        .groupBy("doc_id", "same", "item").agg(F.count("*").alias("n_shared"))
    sure = pairs.join(shared, ["doc_id", "same", "item"]).filter(F.col("n_shared") * den >= F.col("n") * num)
    return sure.select(F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id"), "same", "item_id", "item", "n_shared", F.col("n").cast("long").alias("n_item"))


def contamination(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, **columns) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, a row for each id and item; of an id's several texts the largest count."""
    found = contaminated(docs, items, k, num, den, **columns)
    return found.groupBy("doc_id", "item_id", "item", "n_item").agg(F.max("n_shared").alias("n_shared")).select("doc_id", "item_id", "n_shared", "n_item")


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that hold no item: without the rows of ``contaminated``; without all texts
    of an id, where ``found`` tells ids alone."""
    if "same" in found.columns:
        return without_rows(docs, found.select("doc_id", "same"), F.col(id_col).cast("long"), text_hash(F.col(text_col)))
    return without_rows(docs, found.select("doc_id"), F.col(id_col).cast("long"))
