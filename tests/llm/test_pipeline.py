"""The corpus pipeline, each stage against brute force on what the one before kept."""

import os

import cases
from test_operators import brute_stats, check_packing

import corpus_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {n: {r.doc_id: r.text for r in rows} for n, rows in seen.items() if n != "pack"}

    def fails(t):
        n, _, _, _, repeated = brute_stats(t)
        return n < 10 or 100 * repeated > 20 * n

    # so few labels prove no cutoff: the base alone decides
    assert set(text["quality"]) == {d for d, t in text["documents"].items() if not fails(t)}
    assert set(text["lines"]) == set(text["quality"])
    assert all(set(t.split("\n")) <= set(text["quality"][d].split("\n")) for d, t in text["lines"].items())
    groups = cases.jaccard_components(sorted(text["lines"].items()), 5, 80, 100)
    assert set(text["near_duplicates"]) == {d for d, (_, c) in groups.items() if d == c}
    items = [cases.shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in text["near_duplicates"].items() if not any(100 * len(i & cases.shingles(t, 5)) >= 80 * len(i) for i in items)}
    assert set(text["benchmark"]) == clean
    check_packing(seen["pack"], list(text["benchmark"].items()))


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = cases.documents(spark, extra=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "pack" or docs.columns == columns
        if name == "near_duplicates":
            kept = {(r.doc_id, r.text) for r in docs.collect()}
            # of the texts with _A the smallest id stays; the nameless one, a near copy, goes
            assert (6, cases._A) in kept and not {d for d, _ in kept} & {7, 8, 9, 12, None}
    assert docs.count() > 0


def test_no_row_goes_for_the_text_of_another(spark):
    good = lambda i: " ".join(f"{chr(97 + (i * 7 + j) % 26)}ord{chr(97 + j % 26)}{chr(97 + i)}" for j in range(30))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, good(0)), (None, "junk"), (5, good(1)), (5, "bad"), (6, good(2)), (5, good(1) + " tail"), (5, "own text " + item), (None, "nameless " + item)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], cases.DOCUMENTS)
    stages = dict(corpus_pipeline.STAGES)
    five = stages["quality"](spark, docs, SF)
    assert sorted(r.text for r in five.collect()) == sorted(t for _, t in rows if t not in ("junk", "bad"))
    assert sorted(r.text for r in stages["benchmark"](spark, five, SF).collect()) == sorted([good(0), good(1), good(2), good(1) + " tail"])
    near = stages["near_duplicates"](spark, docs.unionAll(docs), SF).collect()
    texts = [r.text for r in near]
    # near copies under one id, or without one, are two documents, of which one stays; everything else is a text of its own
    assert len(texts) == len(set(texts)) == 6 and {good(0), good(2), "junk", "bad"} <= set(texts)
    assert len({good(1), good(1) + " tail"} & set(texts)) == len({"own text " + item, "nameless " + item} & set(texts)) == 1


def test_empty_tables_pass_every_stage(spark, tmp_path):
    docs = cases.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
