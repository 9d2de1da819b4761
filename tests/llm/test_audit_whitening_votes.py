"""Filter audit, whitening and quality votes against brute force, and on odd tables."""

import itertools
import math
import os
import random
import re
import zlib
from fractions import Fraction

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotlink.llm import catalog, filter_audit, quality_votes, whitening

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
AUDIT = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()

# 11 filter audit


def brute_audit(rows, labels):
    """{(part, order, step): AUDIT} by walking every document through every order."""
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in range(2))
    first, fails, parts = {}, [], {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, part in rows:
        t = t or ""
        ws = cases.words(t)
        f = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        fails.append((part or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out, total = {}, {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                earlier = set(order[:step - 1])
                here = [x for x in own if letter in x[1] and not x[1] & earlier]
                out[part, order, step] = [sum(not x[1] & {*earlier, letter} for x in own), len(here), sum(letter in x[1] and bool(x[1] & earlier) for x in own),
                                          sum(x[1] == {letter} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
                total[part, letter] = total.get((part, letter), 0) + len(here)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in AUDIT) for r in df.collect()}


def test_audit_equals_walking_every_order(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(200)] + ["Big", "LOUD", "a|b", "#"]
    texts = [" ".join(draw.choices(words[:draw.choice([40, 200, 204])], k=draw.choice([0, 5, 99, 100, 150]))) for _ in range(60)]
    texts += ["LOUD " * 110, "\xa0".join(words), "x\x1cy " * 120, "\U0001f600A" * 20]
    rows = [(i, draw.choice([*texts, None]), draw.choice(["en", "de", None, ""])) for i in range(400)] + [(None, texts[3], "en"), (None, texts[3], "de"), (7, texts[1], "en"), (7, texts[1], "en")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 500, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for c in ("part", "mask", "same", "good", "toxic", "n", "c", "step"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit(1)))
    assert audited(got) == brute_audit(rows, labels)


def test_audit_of_odd_rows(spark):
    docs = cases.documents(spark, extra=True)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(filter_audit.filter_audit(docs, none)) == brute_audit(rows, [])
    assert filter_audit.filter_audit(docs.limit(0), none).count() == 0


def test_intervals_cover_every_rank_once():
    for mask in range(32):
        for step in range(1, 6):
            seen = [0] * 120
            for m, s, _, what, lo, hi in filter_audit.intervals():
                if m == mask and s == step and what != "unique":
                    for r in range(lo, hi):
                        seen[r] += 1
            # a step keeps, removes, finds failing again, or passes over a document that is gone already
            assert max(seen) <= 1 and (mask or seen == [1] * 120)


# 12 whitening


def brute_whitening(rows, most, scale=64, shift=1_000_000):
    """(n, x, deviations, V, components of V) by exact products."""
    fit = [[math.floor(scale * c) + shift for c in v] for v in rows]
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    z = [[n * x[i] - s[i] for i in range(d)] for x in fit]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    return n, z, [sum(c * c for c in r) for r in z], cov, e[::-1][:most], u[:, ::-1][:, :most]


def check_whitening(got, vectors, most):
    n, z, dev, cov, e, u = brute_whitening([v for _, v in vectors], most)
    assert len(got) == n * len(e)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    for (vid, _), zi, di in zip(vectors, z, dev):
        for c in range(len(e)):
            r = by[vid][c + 1]
            assert r.n == n and int(r.deviation) == di
            assert abs(r.explained - e[c] / np.trace(cov)) <= 1e-9 and r.identity_error <= 1e-4
            want = float(np.array(zi, float) / n @ u[:, c] / math.sqrt(e[c]))
            assert abs(abs(r.whitened) - abs(want)) < 1e-6
    w = np.array([[by[v][c + 1].whitened for c in range(len(e))] for v, _ in vectors])
    assert abs(np.cov(w.T, bias=True) - np.eye(len(e))).max() < 1e-6


def test_whitening_equals_exact_products(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r.vec_id, [float(c) for c in r.embedding]) for r in df.collect()]
    check_whitening(catalog.QUERIES["op12_whitening"](spark, SF).collect(), vectors, 32)


def test_whitening_drops_what_is_not_a_vector(spark):
    rng = np.random.default_rng(8)
    good = [(i, rng.normal(0, 3, 4).tolist()) for i in range(90)]
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, nan, 2.0, 3.0]), (103, [inf, 1.0, 2.0, 3.0]), (104, [-inf, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, []), (107, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).withColumn("_x", F.lit("clash"))
    check_whitening(whitening.whitened(df.repartition(3), most=3).collect(), good, 3)
    twice = whitening.whitened(df.union(df.filter("vec_id = 5")).union(df.filter("vec_id = 5").withColumn("vec_id", F.lit(None).cast("long"))), most=3)
    assert twice.filter("vec_id = 5").count() == 6 and twice.filter("vec_id is null").count() == 3 and twice.first().n == 92
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.filter("vec_id >= 100 and vec_id < 105")).count() == 0
    assert whitening.whitened(df.filter("vec_id = 1")).count() == 0  # one point has no variance


def test_sums_are_exact_at_any_size():
    rng = np.random.default_rng(9)
    for top in (100, 1 << 24, 1 << 40, 1 << 61):
        x = rng.integers(-top, top, (5000, 3))
        assert whitening.exact_sums(x) == [sum(map(int, c)) for c in x.T]
        assert whitening.exact_squares(x) == [sum(int(v) ** 2 for v in c) for c in x.T]
        for v in x[:20].ravel():
            of = int(v) ** 3
            assert whitening.whole_of({f"l{i}": b for i, b in enumerate(whitening.limbs_of(of))}) == of
    far = np.array([[1 << 60, 5], [-(1 << 60), 6]])
    assert whitening.centred(far, 9, [0, 99]).tolist() == [[9 << 60, -54], [-9 << 60, -45]]


# 13 quality votes


def test_votes_find_quality_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in catalog.QUERIES["op13_quality_votes"](spark, sf).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, label[d]) for d, r in got.items() if r.held_out and d in label]
    assert sum(p == y for p, y in held) > 0.97 * len(held) and {y for _, y in held} == {0, 1}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())


def test_votes_equal_comparing_each_document_by_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in quality_votes.quality_votes(docs, docs, labels, sample_rows=60).collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    plain = lambda d: d.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    features, prior = quality_votes.taught(plain(docs), labels.select("doc_id", F.col("quality").alias("label")), 60)
    assert 40 <= len(features) <= 60
    held, n = np.zeros(quality_votes.BUCKETS), 0
    for t in rows.values():
        at, _ = quality_votes.buckets_of(t)
        held[at] += 1
        n += len(at) > 0
    assert (n, held.tolist()) == (lambda x: (x[0], x[1].tolist()))(quality_votes.document_counts(plain(docs)))
    v = quality_votes.Voters(np.log((1 + n) / (1 + held)) + 1e-6, features, quality_votes.DIMS, 15, prior)

    def alone(text):
        at, times = quality_votes.buckets_of(text)
        w = times / max(times.sum(), 1) * v.idf[at]
        mine = (w / (np.linalg.norm(w) or 1)) @ v.space[at]
        sims = [round(float(mine @ x) / (np.linalg.norm(mine) or 1), 5) for x in v.vectors]
        last = sorted(sims)[-15]
        votes = [(max(s, 0), y) for s, y in zip(sims, v.labels) if s >= last]
        return sum(s * y for s, y in votes) / sum(s for s, _ in votes) if sum(s for s, _ in votes) > 0 else prior

    assert max(abs(alone(t) - got[d]) for d, t in rows.items()) < 0.02


def test_latent_space_is_that_of_the_full_decomposition():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(50):
        at = np.sort(rng.choice(200, 12, replace=False)).astype(np.int32)
        rows.append((at, rng.random(12)))
    full = np.zeros((50, quality_votes.BUCKETS))
    for i, (at, w) in enumerate(rows):
        full[i, at] = w
    _, s, vt = np.linalg.svd(full, full_matrices=False)
    space = quality_votes.latent(rows, 40)
    assert np.allclose(np.linalg.svd(full @ space, compute_uv=False)[:5], s[:5], rtol=1e-4)


def test_votes_of_odd_rows(spark):
    docs = cases.documents(spark, extra=True).withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(6, 1), (6, 0), (11, 1), (13, 1), (None, 0), (3, None), (999, 1), (4, 7)], "doc_id long, quality int")
    got = quality_votes.quality_votes(docs, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[6] == score[7] and score[0] == score[1] == score[2] == score[5] == 0.75  # of ids 6, 11, 13 and 999 three have a 1
    assert {r.score for r in quality_votes.quality_votes(docs, docs, labels.limit(0)).collect()} == {0.5}
    assert quality_votes.quality_votes(docs.limit(0), docs, labels).count() == 0


@pytest.mark.parametrize("name", ["op11", "op12", "op13"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    slug = next(q for q in catalog.QUERIES if q.startswith(name + "_"))
    assert catalog.QUERIES[slug](spark, str(tmp_path)).count() == 0
