"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text's terms are its words and the shapes of its words (letters, capitals, digits and other signs, runs
as one), and how often a word follows itself. Terms are hashed to buckets; a bucket weighs by its share of
the text and by how few of all documents hold it. A truncated singular value decomposition of a bounded
sample of labelled texts gives the latent space. Every document is projected into it and compared,
block by block, with every labelled vector; the most similar of them vote with their cosine as weight, and
so does everyone tied with the last. What is broadcast has a fixed size: buckets x dims and sample x dims.

Defined cases: a null text is empty; a text without words, or without a similar neighbour, gets the share
of label 1 among the ids learned from; without any label that is 0.5; several labels of an id, or of copies of
one text, count by their lowest; labels that are null, without an id or without a document teach nothing;
repeated rows score alike; very long texts are counted whole; an empty table gives no rows."""

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm.common import pages

BUCKETS, DIMS, SPARE = 1 << 15, 64, 16
#: Signs of a shape: a letter, a capital, a digit, anything else as it is.
SHAPE = bytes(97 if chr(i).islower() or i >= 128 else 65 if chr(i).isupper() else 48 if chr(i).isdigit() else i for i in range(256))
REPEATED = zlib.crc32(b"\0repeated")


def buckets_of(text: str) -> tuple:
    """(buckets, how often each occurs) of the whole text, in order."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0)
    signs = np.frombuffer(raw.translate(SHAPE), np.uint8)
    shapes = Counter(signs[np.concatenate([[True], signs[1:] != signs[:-1]])].tobytes().split())
    counts = Counter(words)
    keys = [*map(zlib.crc32, counts), *[zlib.crc32(s, 1) for s in shapes], REPEATED]
    times = np.array([*counts.values(), *shapes.values(), sum(map(eq, words, words[1:]))], float)
    at, place = np.unique(np.array(keys, np.int64) % BUCKETS, return_inverse=True)
    n = np.bincount(place, times)
    return at[n > 0].astype(np.int32), n[n > 0]


def document_counts(docs: DataFrame) -> tuple:
    """(documents with words, in how many of them each bucket occurs), over every text of ``docs``."""
    def run(frames):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in pages(frames):
            for text in pdf["text"]:
                at, _ = buckets_of(text)
                total[at] += 1
                n += len(at) > 0
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(held, -1), "n": np.append(total[held], n)})

    got = docs.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS at most
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in got:
        out[r["bucket"]] = r["n"]
    return int(out[-1]), out[:-1]


def taught(docs: DataFrame, labels: DataFrame, rows: int) -> tuple:
    """(features of at most ``rows`` labelled texts, share of label 1 among all labelled ids). Half the rows go
    to either label, by hash of the id; which ids is settled before any text is read."""
    known = labels.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("h", F.xxhash64(F.lit(13), "doc_id"))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not count:
        return [], 0.5
    each = max(1, rows // 2)
    bar = F.create_map(*[x for k, n in count.items() for x in (F.lit(k), F.lit(int(min(1.0, 2 * each / n + 0.001) * 1_000_000)))])
    first = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).filter(F.col("rank") <= each).drop("rank")
    ids = first(known.filter(F.pmod("h", F.lit(1_000_000)) < bar[F.col("label")]))  # two halves of ``rows``
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("same")).agg(
        F.min("label").alias("label"), F.min("h").alias("h"), F.min("doc_id").alias("doc_id"), F.any_value("text").alias("text"))

    def run(frames):
        for pdf in pages(frames):
            got = [buckets_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "at": [a.tobytes() for a, _ in got], "n": [n.astype(np.float32).tobytes() for _, n in got]})

    found = first(texts).select("label", "text").mapInPandas(run, "label int, at binary, n binary").collect()  # ``rows`` at most
    features = sorted((r["label"], bytes(r["at"]), bytes(r["n"])) for r in found if len(r["at"]))
    return [(k, np.frombuffer(a, np.int32), np.frombuffer(n, np.float32).astype(float)) for k, a, n in features], count.get(1, 0) / sum(count.values())


def latent(rows: list, dims: int, seed: int = 11) -> np.ndarray:
    """buckets x dims: right singular vectors of the weighted rows (buckets, weights), by subspace iteration."""
    dims = min(dims, len(rows))
    wide = min(dims + SPARE, len(rows))
    space = np.random.default_rng(seed).normal(size=(BUCKETS, wide))
    for _ in range(4):
        left, _ = np.linalg.qr(np.array([w @ space[at] for at, w in rows]))
        inner = np.zeros((wide, BUCKETS))
        for (at, w), q in zip(rows, left):
            inner[:, at] += np.outer(q, w)
        space, _ = np.linalg.qr(inner.T)
    _, _, right = np.linalg.svd(inner, full_matrices=False)
    return np.ascontiguousarray(right[:dims].T, dtype=np.float32)


class Voters:
    """Bucket weights, latent space, labelled vectors and their labels. Tasks get its values, which any worker
    can read, and the class with the function that they run."""

    @classmethod
    def of(cls, values: dict):
        out = cls.__new__(cls)
        out.__dict__.update(values)
        return out

    def __init__(self, idf, features, dims, neighbours, prior):
        self.idf, self.neighbours, self.prior = idf, neighbours, prior
        self.labels = np.array([k for k, _, _ in features], float)
        weighted = [self.weighted(at, n) for _, at, n in features]
        self.space = latent(weighted, dims) if features else np.zeros((BUCKETS, 0), np.float32)
        self.vectors = self.projected(weighted)

    def weighted(self, at, n) -> tuple:
        w = n / max(n.sum(), 1) * self.idf[at]
        size = np.sqrt(w @ w)
        return at, w / size if size else w

    def projected(self, weighted: list) -> np.ndarray:
        out = np.array([w @ self.space[at] for at, w in weighted]).reshape(len(weighted), self.space.shape[1])
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 1e-9, size, np.inf)).astype(np.float32)

    def scores(self, texts: list) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        # rounded, so that copies of a text agree in whichever block they are
        near = np.round(self.projected([self.weighted(*buckets_of(t)) for t in texts]) @ self.vectors.T, 5)
        k = min(self.neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        votes = np.where(near >= last[:, None], np.maximum(near, 0), 0).astype(float)
        total = votes.sum(axis=1)
        return np.where(total > 0, np.clip(votes @ self.labels / np.where(total > 0, total, 1), 0, 1), self.prior)


def quality_votes(docs: DataFrame, training: DataFrame, labels: DataFrame, sample_rows: int = 3000, dims: int = DIMS, neighbours: int = 15,
                  id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score: for every row of ``docs``, from its text alone. ``training``: the rows whose labels may be
    learned, ``sample_rows`` of them at most; counts by bucket are taken over all of ``docs``."""
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    features, prior = taught(plain(training), known, sample_rows)
    n, held = document_counts(plain(docs))
    values = docs.sparkSession.sparkContext.broadcast(vars(Voters(np.log((1 + n) / (1 + held)) + 1e-6, features, dims, neighbours, prior)))

    def run(frames):
        voters = Voters.of(values.value)
        for pdf in pages(frames):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": voters.scores(list(pdf["text"]))})

    return plain(docs).mapInPandas(run, "doc_id long, score double")
