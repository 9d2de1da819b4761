"""Blocks of the Jaccard join hold similar documents together, not all that share a passage."""

import random

from plotlink.llm import jaccard_tree


def test_a_shared_passage_joins_no_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, passages = [], [words(12) for _ in range(41)]
    for i in range(40):
        one, two = words(150), words(150)  # the passages lie in two documents each: too few to be ranked as common
        rows += [(2 * i, " ".join([*one, *passages[i], *two, *passages[i + 1]])), (2 * i + 1, " ".join([*one, *two]))]
    seen, linked = [], jaccard_tree._linked
    monkeypatch.setattr(jaccard_tree, "_linked", lambda base, nodes, blocks, *a: seen.append(blocks.select("component").distinct().count()) or linked(base, nodes, blocks, *a))
    got = jaccard_tree.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}
    assert seen == [40]


def test_sets_of_a_key_that_many_have_and_pairs_of_few_are_all_found(spark):
    rng = random.Random(6)
    base = {g: [f"g{g}w{i}" for i in range(200)] for g in range(6)}
    rows = []
    for g, words in base.items():
        for c in range((2, 3, 16, 17, 40, 5)[g]):
            text = list(words)
            text[rng.randrange(200)] = f"c{g}x{c}"
            rows.append((100 * g + c, " ".join(text[:200 - c % 3])))
    got = {r.doc_id: r.component_id for r in jaccard_tree.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 100 for d, _ in rows}
