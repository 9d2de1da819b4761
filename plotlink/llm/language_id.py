"""Language identification by averaged hashed subword embeddings.

A text is its letters in lower case; every character n-gram within a word and its borders is hashed
to a row of an embedding table. The text's vector is the mean of its rows, scored by a linear
softmax. Table and softmax are trained by stochastic gradient descent in numpy on a bounded sample
of labelled documents, as counts by bucket; part of the sample sets the temperature and the score
under which a prediction is rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any learned
language everything is ``und``; null languages teach nothing; repeated rows are predicted alike; very
long texts are hashed whole, in pieces; an empty table gives no rows."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm.common import BASE, pages, per_worker

BUCKETS, GRAMS, UNKNOWN = 1 << 14, (1, 2, 3), "und"
PIECE = 1 << 20


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text; nothing without a letter."""
    letter = per_worker("letters", _letters)
    out = np.zeros(BUCKETS, np.int64)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letter[c], c, np.uint32(32))
    for n in GRAMS:
        for at in range(0, len(c) - n + 1, PIECE):
            x = c[at:at + PIECE + n - 1]
            m, space = len(x) - n + 1, x == 32
            h = np.full(m, n, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(n):
                    h = h * np.uint64(0x100000001B3) + x[j:j + m]
                h *= np.uint64(BASE)
            ok = ~space[:m] if n == 1 else ~(space[:m] & space[1:1 + m]) if n == 2 else ~space[1:1 + m]
            for j in range(2, n - 1):
                ok &= ~space[j:j + m]
            out += np.bincount((h[ok] >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return out


def features(rows: DataFrame) -> DataFrame:
    """lang, part and sparse bucket counts of each row (text, lang, part)."""
    def run(frames):
        for pdf in pages(frames):
            got = [bucket_counts(x) for x in pdf["text"]]
            at = [np.flatnonzero(c) for c in got]
            yield pd.DataFrame({"lang": pdf["lang"], "part": pdf["part"], "at": [x.astype(np.int32) for x in at], "n": [c[x] for c, x in zip(got, at)]})

    return rows.mapInPandas(run, "lang string, part int, at array<int>, n array<long>")


def sampled(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most ``rows`` labelled texts, as evenly from the languages as they come, by hash of the id."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "lang is not null and text is not null and id is not null").withColumn("h", F.abs(F.xxhash64(F.lit(17), "id") % 1_000_000))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return known.select("text", "lang", F.lit(0).alias("part")).limit(0)
    each = max(1, rows // len(counts))
    # first by a hash threshold that leaves about twice what is wanted, so that no window is large
    bar = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, 2 * each / n + 0.0005) * 1_000_000)))])
    w = Window.partitionBy("lang").orderBy("h", "id", "text")
    some = known.filter(F.col("h") < bar[F.col("lang")]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)
    return some.select("text", "lang", (F.col("rank") % 5 == 0).cast("int").alias("part"))


class Model:
    """languages, and for each bucket its logits: embedding times softmax weights."""

    def __init__(self, languages, logits, bias, temperature, reject_under):
        self.languages, self.logits, self.bias, self.temperature, self.reject_under = languages, logits, bias, temperature, reject_under

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = (counts @ self.logits / max(counts.sum(), 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def train(rows: list, dim: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 32, target: float = 0.99, seed: int = 7) -> Model:
    """rows: (lang, part, buckets, counts); part 1 calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    number, rng = {x: i for i, x in enumerate(languages)}, np.random.default_rng(seed)
    rows = sorted(((number[r[0]], r[1], np.asarray(r[2], np.int64), np.asarray(r[3], float)) for r in rows if len(r[2])), key=lambda r: (r[0], r[1], len(r[2]), r[2].tolist()[:8]))
    fit, check = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, dim)), rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    scale = 20.0  # means of many rows are small
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // batch)):
            grads, dw, db = [], np.zeros_like(weights), np.zeros_like(bias)
            for i in at:
                y, _, where, n = fit[i]
                share = n / n.sum() * scale
                v = share @ table[where]
                z = v @ weights + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                grads.append((where, np.outer(share, weights @ p)))
                dw += np.outer(v, p)
                db += p
            for where, g in grads:
                table[where] -= step / len(at) * g
            weights -= step / len(at) * dw
            bias -= step / len(at) * db
    model = Model(languages, table @ weights * scale, bias, 1.0, 0.0)
    if not check:
        return model
    dense = []
    for y, _, where, n in check:
        dense.append((y, n @ model.logits[where] / n.sum() + bias))
    ys, zs = np.array([y for y, _ in dense]), np.array([z for _, z in dense])

    def loss(t):
        z = zs / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(ys)), ys]))

    model.temperature = min(np.geomspace(0.25, 8, 31), key=loss)
    z = zs / model.temperature
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top, right = p.max(axis=1), p.argmax(axis=1) == ys
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= target
    model.reject_under = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def language_id(docs: DataFrame, training: DataFrame, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, accepted (the score reaches the calibrated bar). Trained on at most
    ``sample_rows`` rows of ``training``; predicts every row of ``docs`` from its text alone."""
    rows = features(sampled(training, sample_rows, id_col, text_col, lang_col)).collect()  # sample_rows at most
    model = docs.sparkSession.sparkContext.broadcast(train([(r["lang"], r["part"], r["at"], r["n"]) for r in rows]))

    def run(frames):
        m = model.value
        for pdf in pages(frames):
            out = []
            for text in pdf["text"]:
                counts = bucket_counts(text) if text else None
                if counts is None or not counts.any() or not m.languages:
                    out.append((UNKNOWN, 0.0, False))
                else:
                    p = m.scores(counts)
                    best = int(p.argmax())
                    out.append((m.languages[best], float(p[best]), bool(p[best] >= m.reject_under)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "accepted": [x[2] for x in out]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, lang_pred string, score double, accepted boolean")
