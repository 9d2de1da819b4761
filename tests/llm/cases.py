"""Small tables with every odd case, and brute-force versions of the operators."""

import collections
import hashlib

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

_A = " ".join(f"alpha{i % 7} beta{i % 11} gamma{i}" for i in range(30))
ODD_TEXTS = [
    None, "", " \t\n ", "one", "one two three", "\n\n", _A, _A, _A + " tail", "tail " + _A, "x" * 5000, "word " * 3000, _A.upper(),
    "é ü ß 日本語   nbsp   em", "a\x1cb\x85c", "line one\nline one\nline two", "[INST] <s> </s> &lt; &amp;", "password = 'abcdefghijkl' AKIA" + "A" * 16,
]


def documents(spark, texts=None, extra=False):
    """The odd texts as documents, with a repeated row, a null id and, if asked, clashing columns."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "de", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[-1]] + [(None, "no id here " + _A, "en", None, 1)] if texts else []
    df = spark.createDataFrame(rows, DOCUMENTS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "kept", "k", "crc", "node", "component", "kind", "part", "stratum", "words", "start", "_id", "blob", "path", "a", "b", "c", "s", "n", "lid", "item_id"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return (text or "").encode().split()


def removed_windows(rows, window=20):
    """doc_id -> (words, removed, hash of what stays), by comparing all windows."""
    own, first = {d: words(t) for d, t in rows}, {}
    for d in sorted(own):
        for i in range(len(own[d]) - window + 1):
            first.setdefault(tuple(own[d][i:i + window]), (d, i))
    out = {}
    for d, ws in own.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i:i + window])] < (d, i):
                gone[i:i + window] = [True] * window
        kept = [w for w, g in zip(ws, gone) if not g]
        out[d] = (len(ws), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def shingles(text, k):
    ws = [w.lower() for w in words(text)]
    return frozenset(tuple(ws[i:i + min(k, len(ws))]) for i in range(len(ws) - min(k, len(ws)) + 1)) if ws else frozenset()


def jaccard_components(rows, k, num, den):
    """doc_id -> (size of its set, smallest doc_id that it reaches), by every pair that shares a shingle."""
    sets, holders, parent = {d: shingles(t, k) for d, t in rows}, collections.defaultdict(list), {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = collections.Counter(e for g in s for e in holders[g])
        for e, n in common.items():
            if den * n >= num * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(d)
    return {d: (len(s), root(d)) for d, s in sets.items()}
