"""The whole rule of line deduplication against a plain version that compares lines and words as they are."""

import collections
import os
import random
import re
import zlib

import cases
import numpy as np
import xxhash

from plotlink.llm import line_templates
from plotlink.llm.common import BASE, MIX1, MIX2, mixed

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def one(x):
    return int(mixed(np.array([x % (1 << 64)], np.uint64))[0])


def brute_kept(rows, least=10, share=0.3, fillings=3):
    """[(doc_id, text that stays)], by dictionaries of token tuples."""
    leaves, held, lines_of = collections.defaultdict(set), collections.defaultdict(dict), []
    for d, text in rows:
        text = text or ""
        lines = [(i, x.encode().split()) for i, x in enumerate(text.split("\n"))]
        lines = [(i, ws) for i, ws in lines if ws]
        hashes = [np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64) for _, ws in lines]
        with np.errstate(over="ignore"):
            lows = [[int((h if salt is None else mixed(h + np.uint64(salt))).min()) for h in hashes] for salt in (None, MIX1, MIX2)]
        for at, (i, ws) in enumerate(lines):
            making = maker = 0
            if len(lines) > 1:
                rest = [min(x for j, x in enumerate(low) if j != at) for low in lows]
                maker = rest[0]
                for x in rest:
                    making = one(making * BASE + x)
            ts = tuple(b"<*>" if re.search(rb"\d", w) else w for w in ws)
            keys = [("whole", ts)]
            if len(ts) - 2 >= 4:
                cut = [2 + (len(ts) - 2) * b // 4 for b in range(5)]
                keys += [(b, ts[:cut[b]], len(ts), ts[cut[b + 1]:]) for b in range(4)]
            leaves[len(ts), ts[:2]].add(making)
            lines_of.append((d, text, i, (len(ts), ts[:2]), maker, making, ts, keys))
    for d, text, i, leaf, maker, making, ts, keys in lines_of:
        if len(leaves[leaf]) >= least:
            for k in keys:
                held[k].setdefault(zlib.crc32(text.encode()), []).append((maker, making, ts))
    often = set()
    for k, texts in held.items():
        signed = lambda x: x if x < 1 << 63 else x - (1 << 64)
        makers = {min(signed(x[0]) for x in v) for v in texts.values()}
        classes = collections.Counter(min(signed(x[1]) for x in v) for v in texts.values())
        many = len(texts) ** 2 >= least * sum(n * n for n in classes.values())
        few = len(makers) >= least and len(makers) >= share * len(texts)
        # a text's filling is the smallest by hash; counted here only where texts have one each
        if (few or many) and (k[0] == "whole" or len({v[0][2] for v in texts.values()}) >= fillings):
            often.add(k)
    gone = collections.defaultdict(set)
    for d, text, i, leaf, _, _, _, keys in lines_of:
        if len(leaves[leaf]) >= least and any(k in often for k in keys):
            gone[text].add(i)
    return sorted((d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[t or ""])) for d, t in rows)


def kept(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], cases.DOCUMENTS).repartition(5)
    return sorted((r.doc_id, r.text) for r in line_templates.line_dedup(df).collect())


def made(n=500, seed=3):
    draw = random.Random(seed)
    words = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    line = lambda k: " ".join(draw.choices(words, k=k))
    near = [line(9) for _ in range(6)]
    rows = []
    for i in range(n):
        body = [line(draw.randint(3, 14)) for _ in range(draw.randint(0, 4))]
        if i % 3 == 0:
            body.insert(0, f"Posted on 2024-0{i % 9 + 1} by {draw.choice(words)} in the news section of today")
        if i % 4 == 0:
            body.append("All rights reserved by the owner of this page")
        if i % 61 == 1:
            body.append("Seen in a few texts only and so it stays here")
        if i % 7 == 0:
            body += ["", " \t", line(2)]
        if i % 5 == 0:
            body = list(near)
            body[draw.randrange(6)] = line(9)
        rows.append((i, "\n".join(body)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, rows[0][1])]


def test_rule_equals_brute_force_on_made_lines(spark):
    rows = made()
    got = kept(spark, rows)
    assert got == brute_kept(rows)
    text = dict(got)
    assert not any("All rights" in t or "Posted on" in t for t in text.values()) and any("Seen in" in t for t in text.values())


def test_rule_equals_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()]
    got = kept(spark, rows)
    assert got == brute_kept(rows) and got != sorted((d, t or "") for d, t in rows)


def test_pages_of_any_size_parse_alike(monkeypatch):
    texts = [t or "" for _, t in made(60)] + [t or "" for t in cases.ODD_TEXTS] + ["12 a\x0b3 é1 ٣ b\r\n\n x", "\n", "a b c d e f", "a b c d e"]
    whole = line_templates.parse(texts)
    each = [line_templates.parse([t]) for t in texts]
    for name in ("line", "leaf", "maker", "making", "templates", "banded"):
        assert (whole[name] == np.concatenate([p[name] for p in each if p])).all(), name
    assert (whole["text"] == np.concatenate([np.full(len(p["line"]), i) for i, p in enumerate(each) if p])).all()
    import pandas as pd

    monkeypatch.setattr(line_templates, "PAGE", 50)
    assert [t for p in line_templates.pieces(pd.DataFrame({"text": texts})) for t in p["text"]] == texts
