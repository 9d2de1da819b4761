"""The operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import math
import os
import random
import re
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotlink.llm import (catalog, chat_format, decontaminate, jaccard_tree, language_id, line_templates, packing, quality_rules, secret_ledger,
                          substring_dedup, token_counts)
from plotlink.llm.components import components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def as_rows(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


# 1 token counts


def test_token_counts_equal_the_public_unigram_tokenizer(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = token_counts.read_vocabulary(path)
    tok = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    texts = [(d, t) for d, t in corpus[:80]] + [(10_000 + i, t) for i, t in enumerate(cases.ODD_TEXTS)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {d: len(tok.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for d, t in texts}
    assert as_rows(token_counts.token_counts(df, path), "doc_id", "n_tokens") == {d: (n,) for d, n in want.items()}


def test_token_counts_break_ties_and_fuse_unknown():
    tied = token_counts.Counter([("<unk>", -9.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁", -1.0), ("▁a", -3.0)])
    assert tied.part("▁ab")[0] == 2  # of equal scores the earliest start: ▁ + ab
    assert tied.part("▁a")[0] == 1
    assert tied.part("zzz")[:2] == (1, 3)  # without byte pieces a run of unknown characters is one token


# 2 substring dedup


@pytest.mark.parametrize("compared", [1 << 20, 64])
def test_substring_dedup_equals_brute_force(spark, corpus, compared, monkeypatch):
    monkeypatch.setattr(substring_dedup, "COMPARED", compared)
    got = substring_dedup.substring_dedup(spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    assert as_rows(got.withColumn("h", F.sha2(F.encode("kept", "UTF-8"), 256)), "doc_id", "n_words", "n_removed", "h") == cases.removed_windows(corpus)


def test_substring_dedup_of_odd_rows(spark):
    got = substring_dedup.substring_dedup(cases.documents(spark, extra=True)).collect()
    rows = [(i, t) for i, t in enumerate(cases.ODD_TEXTS)]
    want = cases.removed_windows(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:  # the row without an id comes first, and has what documents 6 to 9 have
            assert r.n_words == want[r.doc_id][0]
            if r.doc_id not in (6, 7, 8, 9):
                assert (r.n_removed, digest(r.kept)) == want[r.doc_id][1:], r.doc_id
    assert {r.n_removed for r in got if r.doc_id is None} == {0}
    assert {r.n_removed for r in got if r.doc_id in (6, 7)} == {90}


# 3 packing


def check_packing(rows, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, by_doc, by_seq = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, t in texts:
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at:at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    total = padded = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total, padded = total + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    return padded / total


def test_packing_keeps_every_id_once_with_little_padding(spark, corpus):
    assert check_packing(catalog.QUERIES["op3_packing"](spark, SF).collect(), corpus) < 0.05


def test_packing_of_odd_rows(spark):
    import public_tokenizers

    texts = [t for t in cases.ODD_TEXTS] + ["a <|endoftext|> b  c", " lead", "trail ", "don't we'LL 12 3a"]
    for ranks in (None, catalog.ranks()):
        rows = packing.packed(cases.documents(spark, texts, extra=True).filter("doc_id < 21"), public_tokenizers.path("byte_bpe_50k.json"), ranks=ranks).collect()
        check_packing(rows, list(enumerate(texts))[:21])


def test_both_ways_to_token_ids_agree():
    import public_tokenizers

    both = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), catalog.ranks())
    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    signs = [chr(c) for c in range(9, 0x250) if packing._PLAIN.fullmatch(chr(c))] + list("–—‘’“”…      \n\n\t''")
    for _ in range(3000):
        text = "".join(rng.choice(signs, rng.integers(0, 60)))
        assert both.one(text) == own.one(text), repr(text)


def test_cutting_stock_meets_demand_near_its_bound():
    rng = np.random.default_rng(3)
    for demand in (rng.integers(0, 400, 128) * (np.arange(128) < 60), np.eye(128, dtype=np.int64)[5] * 7, np.zeros(128, np.int64)):
        plan, sizes = packing.cutting_stock(demand, 128), np.arange(1, 129)
        assert (sum((p * t for p, t in plan), np.zeros(128, np.int64)) == demand).all()
        assert all(t > 0 and (p * sizes).sum() <= 128 for p, t in plan)
        assert sum(t for _, t in plan) <= math.ceil((demand * sizes).sum() / 128) * 1.01 + 2


# 4 language identification


def test_language_is_learned_from_text_alone(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang", "text")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    got = language_id.language_id(test, train, sample_rows=300).join(test, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) > 0.8 * len(got)


def test_language_of_odd_rows(spark):
    docs = cases.documents(spark, extra=True)
    got = language_id.language_id(docs, docs).collect()
    assert len(got) == docs.count()
    letters = {i: any(c.isalpha() for c in t or "") for i, t in enumerate(cases.ODD_TEXTS)}
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not letters[r.doc_id])
    assert {r.lang_pred for r in language_id.language_id(docs, docs.limit(0)).collect()} == {"und"}


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    text = "Größe är ett ord, " * 50
    whole = language_id.bucket_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert (language_id.bucket_counts(text) == whole).all()


# 5 decontamination


def test_contamination_equals_exact_containment(spark, corpus):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i): len(cases.shingles(t, 5) & cases.shingles(x, 5)) for d, t in corpus for i, x in items}
    want = {k: n for k, n in want.items() if n and 100 * n >= 80 * len(cases.shingles(dict(items)[k[1]], 5))}
    got = {(r.doc_id, r.item_id): r.n_shared for r in catalog.QUERIES["op5_decontaminate"](spark, SF).collect()}
    assert got == want and want
    # cutoffs that reject no good text are on as strict as they come
    out = quality_rules.judged(measured, quality_rules.thresholds(measured, labels)).filter("not base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    assert out.filter("quality = 0 and not kept").count() > 0.9 * out.filter("quality = 0").count()
    assert out.filter("quality = 1 and not kept").count() <= 0.01 * out.filter("quality = 1").count()


def test_contamination_of_odd_rows(spark):
    docs = cases.documents(spark, extra=True)
    items = spark.createDataFrame([(1, cases._A), (2, None), (3, ""), (4, "ONE"), (None, "one two three"), (1, cases._A)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, items).collect()}
    # a short item is found wherever its words stand
    assert got == {(6, 1), (7, 1), (8, 1), (9, 1), (12, 1), (None, 1), (3, 4), (4, 4), (15, 4), (4, None)}
    assert decontaminate.clean(docs, decontaminate.contamination(docs, items)).count() == docs.count() - 9
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_short_items_are_found_inside_long_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 4, 30, 200])))) for i in range(120)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 2, 3, 4, 5, 6, 9])] + [(20, " ".join(docs[5][1].split()[:3]).upper())]

    def inside(item, text):
        i, t = item.lower().split(), text.split()
        if len(i) < 5:
            return any(t[at:at + len(i)] == i for at in range(len(t)))
        a, b = cases.shingles(item, 5), cases.shingles(text, 5)
        return 100 * len(a & b) >= 80 * len(a)

    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if inside(x, t)} and len(got) > 40


def test_documents_of_one_id_are_judged_each_by_its_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(5, item), (5, "clean text of the same id"), (None, item + " more"), (None, "clean text without an id")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.text for r in decontaminate.clean(docs, found).collect()) == ["clean text of the same id", "clean text without an id"]


def test_only_sketches_that_meet_are_verified(spark):
    """What shares no sketch shingle of a partition is no candidate, whatever else it shares."""
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate([30, 60, 200])], "item_id long, text string")
    sketches = decontaminate.item_sketches(items.withColumnRenamed("item_id", "doc_id"), 5, 80, 100).collect()
    known = decontaminate._known(decontaminate.item_sketches(items.withColumnRenamed("item_id", "doc_id"), 5, 80, 100))
    assert sorted(known["bounds"]) == sorted({r.part for r in sketches}) and not known["short"]
    for r in sketches:
        h = decontaminate.mixed(np.array([r.shingle], np.int64).view(np.uint64))
        assert decontaminate.has(known["every"], decontaminate._cells(h))[0]
        assert not r.probe or (int(h[0]) <= known["bounds"][r.part] and decontaminate.has(known["probes"], decontaminate._cells(h, r.part))[0])
    assert sum(r.probe for r in sketches) < 0.5 * len(sketches)


def test_repeated_items_count_once_and_items_of_one_id_stay_apart(spark):
    ws = [f"w{i}" for i in range(54)]  # 50 shingles
    docs = spark.createDataFrame([(1, " ".join(ws[:24] + [f"x{i}" for i in range(30)]), "en", "s", 0), (2, " ".join(ws[:49]), "en", "s", 0)], cases.DOCUMENTS)  # 20 and 45 of them
    other = " ".join(ws[:5] + ws[10:15] + [f"v{i}" for i in range(44)])  # 2 of document 2's, as many in all
    items = spark.createDataFrame([(7, " ".join(ws)), (7, " ".join(ws)), (7, other), (None, " ".join(ws)), (None, " ".join(ws)), (None, other), (None, " ".join(ws[:49]))], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(docs, items.repartition(3)).collect()), key=str)
    assert got == [(2, 7, 45, 50), (2, None, 45, 45), (2, None, 45, 50)]


# 6 quality rules


def brute_stats(text):
    ws, text = cases.words(text), text or ""
    grams, seen, dup, mark = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)], set(), 0, set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            mark.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(len(w.decode()) for w in ws), len(re.findall(r"[#*$%&|<>]", text)), dup, len(mark)


def test_quality_counts_equal_brute_force(spark):
    for text in [*cases.ODD_TEXTS[:11], *cases.ODD_TEXTS[12:], "a b c d e f a b c d e g\n# * $ %\n\n# * $ %"]:
        assert quality_rules.measure(text or "")[:5] == brute_stats(text)


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 50, 0.02), (3, 400, 0.02), (7, 1000, 0.01)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality_rules.tail(k, n, p) - want) < 1e-12
    assert quality_rules.tail(10, 100, 0.05) == 1.0


def test_thresholds_hold_the_risk_and_find_bad_documents(spark):
    good = [(i, f"plain words of text number {i} that nobody would ever want to reject here today", "en", "s", 0) for i in range(6000)]
    bad = [(10_000 + i, f"buy ### $$$ %%% now {i} *** &&& ||| cheap <<< >>> offer for you all today", "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(good + bad, cases.DOCUMENTS)
    labels = spark.createDataFrame([(d[0], int(d[0] < 10_000)) for d in good + bad], "doc_id long, quality int")
    out = quality_rules.quality(docs, labels).cache()
    assert out.filter("doc_id >= 10000 and kept").count() == 0 and out.filter("doc_id < 10000 and not kept").count() == 0
    few = quality_rules.quality(docs, labels.filter("doc_id >= 5900"))  # too few good ones to prove anything
    assert few.filter("kept").count() == 6200


def test_strata_of_few_labels_are_judged_together(spark):
    langs = ["de", "fr", None]
    good = [(i, f"plain words of text number {i} that nobody would ever want to reject here today", langs[i % 3], "s", 0) for i in range(1800)]
    bad = [(10_000 + i, f"buy ### $$$ %%% now {i} *** &&& ||| cheap <<< >>> offer for you all today", langs[i % 3], "s", 0) for i in range(150)]
    docs = spark.createDataFrame(good + bad, cases.DOCUMENTS)
    out = quality_rules.quality(docs, spark.createDataFrame([(d[0], int(d[0] < 10_000)) for d in good + bad], "doc_id long, quality int")).cache()
    assert out.filter("doc_id >= 10000 and kept").count() == 0 and out.filter("doc_id < 10000 and not kept").count() == 0


def test_copies_of_one_text_prove_nothing(spark):
    good = [(i, "plain words of one text that nobody would ever want to reject here today", "en", "s", 0) for i in range(3000)]
    bad = [(10_000 + i, f"buy ### $$$ %%% now {i} *** &&& ||| cheap <<< >>> offer for you all today", "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(good + bad, cases.DOCUMENTS)
    out = quality_rules.quality(docs, spark.createDataFrame([(d[0], int(d[0] < 10_000)) for d in good + bad], "doc_id long, quality int"))
    assert out.filter("kept").count() == 3200


def test_all_rules_of_a_stratum_together_hold_the_risk(spark):
    """Five rules that each reject 0.6 % of good texts, 3 % together: no path may take them all at a risk of 2 %."""
    rng, filler = random.Random(5), [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnprst"]
    def text(kind):
        ws = rng.sample(filler, 70) + ["considerable"] * 1
        if kind == 1:
            ws += ["#### $$$$ %%%%"] * 4
        if kind == 2:
            ws = [w * 4 for w in ws]
        if kind == 3:
            return "\n".join([" ".join(ws[:12])] * 4 + [" ".join(ws[12:])])
        if kind == 4:
            ws = ws[:12]
        if kind == 5:
            ws = [w[0] for w in rng.choices(filler, k=60)]
        return " ".join(ws)

    n = 8000
    good = [(i, text(i % 167 + 1 if i % 167 < 5 else 0), "en", "s", 0) for i in range(n)]
    bad = [(100_000 + i, text(i % 5 + 1), "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(good + bad, cases.DOCUMENTS)
    labels = spark.createDataFrame([(d[0], int(d[0] < 100_000)) for d in good + bad], "doc_id long, quality int")
    measured = quality_rules.stats(docs).cache()
    for risk in (0.02, 0.05):
        cut = quality_rules.thresholds(measured, labels, risk=risk)
        out = quality_rules.judged(measured, cut).filter("not base_failed")
        lost = out.filter("doc_id < 100000 and not kept").count() / out.filter("doc_id < 100000").count()
        assert lost <= risk, (risk, lost)
        rows = cut.collect()
        assert rows and len({(r.n, r.k, r.p) for r in rows}) == 1 and quality_rules.tail(rows[0].k, rows[0].n, risk) <= 0.05
    assert len(rows) >= 4  # at 5 % all of use are on


def test_thresholds_equal_a_plain_version(spark):
    docs = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet")
    labels = spark.read.parquet(SF.replace("0.001", "0.1") + "/labels.parquet")
    measured = quality_rules.stats(docs).cache()
    got = {(r.stratum, r.rule): (r.cutoff, r.n, r.k, r.pooled) for r in quality_rules.thresholds(measured, labels).collect()}
    good = {}
    for r in labels.collect():
        good[r.doc_id] = min(r.quality, good.get(r.doc_id, 1))
    held = {r.same: r.h == 0 for r in measured.select("same", F.pmod(F.xxhash64(F.lit("holdout"), "same"), F.lit(2)).alias("h")).collect()}
    texts = {}
    for r in measured.collect():
        if r.doc_id in good and not (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words):
            key = (r.stratum, r.same)
            texts[key] = (r, min(good[r.doc_id], texts[key][1] if key in texts else 1))

    def rejects(r, rule, cutoff):
        num, factor, den, sign, _ = quality_rules.RULES[rule]
        v = r[num] if den is None else r[num] * factor // max(r[den], 1)
        return v > cutoff if sign > 0 else v < cutoff

    strata = {s for s, _ in texts}
    n_held = {s: sum(held[h] and y == 1 for (t, h), (_, y) in texts.items() if t == s) for s in strata}
    need = quality_rules.least_labels(len(strata), 0.01, 0.05)
    judge = {s: "pool" if n_held[s] < need else s for s in strata}
    want, made = {}, {}
    for j in set(judge.values()):
        own = [(r, y, held[h]) for (s, h), (r, y) in texts.items() if judge[s] == j]
        cuts = []
        for rule, spec in quality_rules.RULES.items():
            late, of_rule = 0.0, {}
            for strict, c in enumerate(sorted(spec[4], reverse=spec[3] > 0)):
                out = [y for r, y, x in own if not x and rejects(r, rule, c)]
                if out and out.count(0) >= 0.9 * len(out) and out.count(0):
                    late = max(late, out.count(1) / len(out))
                    of_rule[late] = (late, -out.count(0), rule, strict, c)  # the strictest of equally good ones
            cuts += of_rule.values()
        made[j] = sorted(cuts)
    n_paths = sum(bool(p) for p in made.values())
    for j, path in made.items():
        trials = [r for (s, h), (r, y) in texts.items() if judge[s] == j and held[h] and y == 1]
        for at in range(len(path)):
            k = sum(any(rejects(r, rule, c) for _, _, rule, _, c in path[:at + 1]) for r in trials)
            if not trials or quality_rules.tail(k, len(trials), 0.01) > 0.05 / n_paths:
                break
            for s in strata:
                if judge[s] == j:
                    for _, _, rule, _, c in path[:at + 1]:
                        want[s, rule] = (c, len(trials), k, j == "pool")
    assert got == want and want


def test_quality_of_odd_rows(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([(None, 1), (3, None), (999, 0)], "doc_id long, quality int")
    rows = quality_rules.quality(docs, none).collect()
    assert len(rows) == docs.count() and all(r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.kept_documents(docs, quality_rules.quality(docs, none)).columns == docs.columns


# 7 line templates


def test_recurring_templates_go_and_copies_stay(spark):
    own = lambda i: " ".join(hashlib.md5(f"{i} {j}".encode()).hexdigest()[:6].translate(str.maketrans("0123456789", "ghijklmnop")) for j in range(12))
    rows = [(i, f"{own(i)}\nPosted by user{i} on 2024-01-{i % 28 + 1:02d}\n{own(-i - 1)}\nShare this story with {own(i * 7 + 1)[:6]} and all friends now", "en", "s", 0) for i in range(60)]
    rows += [(1000 + i, "\n".join(own(5000 + j) for j in range(5)), "en", "s", 0) for i in range(40)]
    rows += [(2000 + i, "\n".join(own(6000 + j) for j in range(5)) + f" edit{i}", "en", "s", 0) for i in range(40)]
    got = {r.doc_id: r for r in line_templates.line_dedup(spark.createDataFrame(rows, cases.DOCUMENTS)).collect()}
    for i in range(60):
        assert got[i].text == rows[i][1].split("\n")[0] + "\n" + rows[i][1].split("\n")[2] and got[i].n_dropped == 2 and got[i].n_lines == 4
    assert all(r.n_dropped == 0 for d, r in got.items() if d >= 1000)


def test_a_line_of_very_many_texts_recurs_and_many_near_copies_stay(spark):
    draw = random.Random(7)
    words = [f"word{i}" for i in range(120)]
    text = lambda: "\n".join(" ".join(draw.sample(words, 10)) for _ in range(2))
    rows = [(i, text() + "\nAll rights to this page belong to its owner", "en", "s", 0) for i in range(600)]
    near = [f"part{i}" for i in range(60)]
    for i in range(600):
        own = list(near)
        for j in draw.sample(range(60), 3):
            own[j] = f"edit{i}x{j}"
        rows.append((10_000 + i, "\n".join(" ".join(own[k:k + 12]) for k in range(0, 60, 12)), "en", "s", 0))
    got = {r.doc_id: r for r in line_templates.line_dedup(spark.createDataFrame(rows, cases.DOCUMENTS)).collect()}
    assert all("All rights" not in got[i].text for i in range(600))
    assert all(r.n_dropped == 0 for d, r in got.items() if d >= 10_000)


def test_line_templates_of_odd_rows(spark):
    docs = cases.documents(spark, extra=True)
    got = line_templates.line_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert line_templates.without(docs, line_templates.dropped_lines(docs)).count() == docs.count()


# 8 secret ledger

_BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]


def base_spans(text):
    out = [(m.start(), i, kind, m.end()) for i, (kind, p, g, n) in enumerate(_BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_secrets_equal_the_patterns(spark, corpus):
    odd = ["token=secret: abcdefghijklmnop", "TOKEN token = 'abc' Api_Key:\"0123456789abcdef0\"", "é👍 password=abcdefghijkl", "AKIAAKIA" + "B" * 12, "AKIA" + "0" * 13, "f" * 16 + "g" + "0" * 15,
           "-----BEGIN RSA PRIVATE KEY-----", "", None, "secret:secret:secret=aaaaaaaaaaaaaaaa", "token=\n=abcdefghijklmnop", "apikey='" + "x" * 5000]
    texts = [*corpus, *[(10_000 + i, t) for i, t in enumerate(odd)], (10_000, odd[0])]
    versions = secret_ledger.versioned(spark.createDataFrame(texts, "doc_id long, text string"))
    got = secret_ledger.digest(secret_ledger.findings(versions, secret_ledger.scan(versions))).collect()
    assert len(got) == len(texts)
    by = dict(texts)
    for r in got:
        want = base_spans(by[r.doc_id])
        assert r.base_sha256 == digest(want) and r.n_assign + r.n_access + r.n_hex == (want.count(",") + 1 if want else 0)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_very_many_spans_take_time_in_proportion(spark):
    import time

    text = lambda n: " ".join(f"{i:016x}" for i in range(n))
    times = []
    for n in (500, 40_000):
        versions = secret_ledger.versioned(spark.createDataFrame([(1, text(n)), (2, "none")], "doc_id long, text string").withColumn("start", F.lit("clash")))
        start = time.time()
        row = secret_ledger.digest(secret_ledger.findings(versions, secret_ledger.scan(versions))).filter("doc_id = 1").first()
        times.append(time.time() - start)
        assert row.n_hex == n and row.base_sha256 == digest(base_spans(text(n)))
    assert times[1] < 20  # the square of it would take minutes


def test_a_ledger_written_twice_lists_spans_once(spark):
    versions = secret_ledger.versioned(spark.createDataFrame([(1, "token=abcdefghijkl " + "f" * 16), (2, "x")], "doc_id long, text string"))
    once = secret_ledger.scan(versions)
    got = {r.doc_id: r.spans for r in secret_ledger.digest(secret_ledger.findings(versions, once.union(once))).collect()}
    assert got == {r.doc_id: r.spans for r in secret_ledger.digest(secret_ledger.findings(versions, once)).collect()} and got[1].count(",") == 1


def test_ledger_scans_only_what_it_lacks(spark):
    first = secret_ledger.versioned(spark.createDataFrame([("a", "token=abcdefghijkl"), ("b", "nothing"), ("c", "nothing")], "doc_id string, text string"))
    path = secret_ledger.extended(first, None)
    assert spark.read.parquet(path).count() == 2 * len(secret_ledger.RULES)
    second = first.union(secret_ledger.versioned(spark.createDataFrame([("a", "token=zzzzzzzzzzzz new")], "doc_id string, text string")))
    new = secret_ledger.scan(second, spark.read.parquet(path))
    assert new.select("blob").distinct().count() == 1 and new.count() == len(secret_ledger.RULES)
    changed = (secret_ledger.Rule("hex", r"[0-9a-f]{8,}", version=2), *secret_ledger.RULES[:2])
    assert {r.kind for r in secret_ledger.scan(first, spark.read.parquet(path), changed).collect()} == {"hex"}
    secret_ledger.extended(second, path)
    assert secret_ledger.scan(second, spark.read.parquet(path)).count() == 0
    found = secret_ledger.findings(second, spark.read.parquet(path))
    assert found.filter("size(spans) > 0").count() == 2 and found.count() == 4


# 9 Jaccard join


@pytest.mark.parametrize("k,num,den,chunk", [(4, 85, 100, 1 << 21), (5, 80, 100, 2000)])
def test_jaccard_components_equal_brute_force(spark, corpus, k, num, den, chunk):
    got = jaccard_tree.jaccard_join(spark.read.parquet(f"{SF}/documents.parquet"), k, num, den, chunk_shingles=chunk)
    assert as_rows(got, "doc_id", "n_shingles", "component_id") == cases.jaccard_components(corpus, k, num, den)


def test_jaccard_of_many_near_copies_in_chunks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        ws = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            ws[at] = f"v{rng.integers(0, 1000)}"
        texts.append((i, " ".join(ws)))
    texts += [(1000 + i, " ".join(f"u{rng.integers(0, 40)}" for _ in range(60))) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = cases.jaccard_components(texts, 4, 85, 100)
    for chunk in (1 << 21, 1500):
        assert as_rows(jaccard_tree.jaccard_join(df, chunk_shingles=chunk), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_of_odd_rows(spark):
    got = jaccard_tree.jaccard_join(cases.documents(spark, extra=True)).collect()
    assert len(got) == len(cases.ODD_TEXTS) + 2
    want = cases.jaccard_components(list(enumerate(cases.ODD_TEXTS)), 4, 85, 100)
    for r in got:
        if r.doc_id is not None:
            assert r.n_shingles == want[r.doc_id][0]
    groups = {r.doc_id: r.component_id for r in got}
    assert groups[6] == groups[7] == groups[12] == groups[None] and groups[3] == 3 and groups[0] == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {x: (root(x),) for x in parent}
    assert as_rows(components(spark.createDataFrame(pairs, "a long, b long")), "node", "component") == want


# 10 chat formatting


def test_chat_round_trip(spark):
    turns = {r.conv_id: [] for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().collect()}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = as_rows(catalog.QUERIES["op10_chat_format"](spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == {c: chat_digest(sorted(ts)) for c, ts in turns.items()}


def chat_digest(ts):
    loss = "".join(t for _, role, t in ts if role == "assistant")
    return len(ts), digest("".join(f"{role}\n{t}\n" for _, role, t in ts)), len(loss), digest(loss)


def test_chat_of_odd_rows(spark):
    hostile = ["&lt;s>", "&amp;lt;s>", "&&lt;<s></s><</s>", "[INST][/INST] [[INST]", "&#91;INST]", "&#10;", "a\nb\n", "", "👍</s>é", "&amp;"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(hostile)]
    rows += [(2, None, None, None, "x"), (2, 1, "assistant", None, "x"), (2, 1, "assistant", "same", "x"), (2, 1, "assistant", "same", "x"), (3, 0, "sys\ntem</s>", "q", "x"), (None, 0, "user", "lost", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_start string")
    ex = chat_format.examples(df)
    assert ex.filter("conv_id = 1").count() == 5 and ex.filter("conv_id = 3 and loss_start = loss_end").count() == 1
    whole = as_rows(chat_format.digests(ex), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    by = {}
    for c, n, role, t, _ in rows:
        by.setdefault(c, []).append((-1 if n is None else n, role or "", t or ""))
    assert whole == {c: chat_digest(sorted(ts)) for c, ts in by.items()}
    assert chat_format.digests(chat_format.examples(df.limit(0))).count() == 0


# empty tables


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9"])
def test_empty_documents_give_no_rows(spark, tmp_path, name):
    cases.documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    for other in ("labels", "benchmark", "conversations"):
        spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(str(tmp_path / f"{other}.parquet"))
    slug = next(q for q in catalog.QUERIES if q.startswith(name + "_"))
    assert catalog.QUERIES[slug](spark, str(tmp_path)).count() == 0
