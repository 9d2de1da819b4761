"""Exact substring deduplication over word windows, with a count-min prefilter.

Documents whose word sequences are equal to an earlier one are settled first: all their windows
start earlier. Each window of the others is represented by its minimiser (the smallest hash of its
word k-grams), which equal windows share. Pass one counts minimisers in count-min sketches, one for
each partition, merged by saturating addition; an estimate is never below a window's count. Pass two
keeps only the windows whose minimiser may occur twice and groups those exactly, so none is lost.
The merged sketch has a fixed size; over corpora that fill it more windows are grouped, never fewer.

Defined cases: a null or empty text has no words; texts under a window long lose nothing; order is
(doc_id, start), a null doc_id first; rows that repeat doc_id and words are judged alike, none
against the other; an empty table gives no rows."""

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm.common import MIX2, as_long, by_key, id_and_text, mixed, pages, ranges, rolling, word_hashes, words_of, written

GRAM = 12
#: Windows that a task compares with each other at a time.
COMPARED = 1 << 18
#: Counters of each row of the sketch and rows; 2 x 2^27 bits (32 MB) are broadcast, whatever the input.
WIDTH_BITS, DEPTH, BLOCK_BITS = 27, 2, 20
_NULL_ID = -(1 << 63)


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(h + np.uint64((row + 1) * MIX2 & (1 << 64) - 1)) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) of every n consecutive values, by doubling."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = f(out[:len(out) - step], out[step:])
        have += step
    return out


def minimisers(words: np.ndarray, doc_of: np.ndarray, window: int):
    """(k-gram hashes, minimiser hash of each window, which windows lie in one document)."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)
    grams = rolling(words, GRAM)
    least = _slide(grams, window - GRAM + 1, np.minimum)
    inside = doc_of[:len(least)] == doc_of[window - 1:]
    return grams, least, inside


def _chosen(grams: np.ndarray, least: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    """Which k-grams are the minimiser of a window: one count for each occurrence in the text."""
    span = window - GRAM + 1
    most = _slide(np.concatenate([np.zeros(span - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(span - 1, np.uint64)]), span, np.maximum)
    return (most == grams) & (grams > 0)


def _batch(texts, window: int):
    words = [words_of(x) for x in texts]
    n = np.array([len(w) for w in words], np.int64)
    hashes = word_hashes([y for w in words for y in w])
    return words, n, hashes, np.repeat(np.arange(len(n)), n)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, crc32 of the text, n_words and the hash of the word sequence (joined by one space)."""
    def run(frames):
        for pdf in pages(frames):
            words = [words_of(x) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "crc": pdf["crc"], "n_words": [len(w) for w in words],
                                "sha": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]})

    return docs.mapInPandas(run, "doc_id long, crc long, n_words long, sha string")


def _news(frames):
    """Pages without documents that a task has already seen under a smaller doc_id."""
    seen = {}
    for pdf in pages(frames):
        keep = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            key = hashlib.md5(b" ".join(words_of(text))).digest()
            keep.append(seen.get(key, doc + 1) > doc)
            if keep[-1]:
                seen[key] = doc
        yield pdf[keep]


def sketch(docs: DataFrame, window: int) -> bytes:
    """The merged count-min sketch, as bits: which counters stand at two or more. Each task sends
    its counters as compressed blocks; they are added up, stopping at two, where they meet."""
    size, block = 1 << WIDTH_BITS, 1 << BLOCK_BITS
    blocks = size // block

    def run(frames):
        counts = [np.zeros(size >> 2, np.uint8) for _ in range(DEPTH)]  # four 2-bit counters a byte

        def add(row, cells):
            cells, n = np.unique(cells, return_counts=True)
            for s in range(4):  # among these no byte repeats
                own = (cells & 3) == s
                at, shift = cells[own] >> 2, np.uint8(2 * s)
                old = (counts[row][at] >> shift) & np.uint8(3)
                counts[row][at] = (counts[row][at] & np.uint8(255 ^ (3 << 2 * s))) | (np.minimum(old + n[own], 2).astype(np.uint8) << shift)

        for pdf in _news(frames):
            _, n, hashes, doc_of = _batch(pdf["text"], window)
            grams, least, inside = minimisers(hashes, doc_of, window)
            if len(least):
                keys = grams[_chosen(grams, least, inside, window)]
                for row in range(DEPTH):
                    add(row, _cells(keys, row))
        for row in range(DEPTH):
            for b in range(0, blocks, 16):
                parts = [(row * blocks + i, counts[row][i * block >> 2:(i + 1) * block >> 2]) for i in range(b, b + 16)]
                yield pd.DataFrame([(i, zlib.compress(x.tobytes(), 1)) for i, x in parts if x.any()], columns=["block", "counts"])

    def merge(frames):
        total = {}
        for pdf in frames:
            for i, x in zip(pdf["block"], pdf["counts"]):
                old, new = total.get(i), np.frombuffer(zlib.decompress(x), np.uint8)
                if old is not None:  # added for each of the four counters of a byte, two at most
                    sums = [np.minimum(((old >> np.uint8(s)) & 3) + ((new >> np.uint8(s)) & 3), 2) << np.uint8(s) for s in (0, 2, 4, 6)]
                    new = sums[0] | sums[1] | sums[2] | sums[3]
                total[i] = new
        for i, x in total.items():
            two = np.stack([(x >> np.uint8(s)) & 3 == 2 for s in (0, 2, 4, 6)], axis=1).reshape(-1)
            yield pd.DataFrame({"block": [i], "bits": [np.packbits(two).tobytes()]})

    merged = docs.mapInPandas(run, "block int, counts binary").repartition("block").mapInPandas(merge, "block int, bits binary")
    out = np.zeros(DEPTH * size >> 3, np.uint8)
    for r in merged.toLocalIterator():  # DEPTH rows of 2^WIDTH_BITS bits, whatever the input
        out[r["block"] * block >> 3:(r["block"] + 1) * block >> 3] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _judge(h, w, k, start):
    """Which windows have the same sequence (equal h and w) at a smaller (k, start) among the given."""
    order = np.lexsort((start, k, w, h))
    new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (k[order] > k[first]) | ((k[order] == k[first]) & (start[order] > start[first]))
    out = np.zeros(len(h), bool)
    out[order] = later
    return out


def _rows(h, w, k, crc, start, gone):
    """Runs of windows as rows: those to be compared further with their hashes, those gone without."""
    first, n = ranges(start, np.cumsum(np.concatenate([[0], (np.diff(k) != 0) | (np.diff(crc) != 0) | (np.diff(gone) != 0) | ((np.diff(h) != 0) & ~gone[1:])]))) if len(h) else ranges(start, start)
    data = w.tobytes()
    # what is settled goes under a hash of its document: it meets no other row, so it need not crowd a window's
    to = np.where(gone[first], as_long(mixed((k[first] * 31 + crc[first]).view(np.uint64))), h[first])
    return pd.DataFrame({"h": to, "k": k[first], "crc": crc[first], "start": start[first].astype(np.int32), "n": n.astype(np.int32),
                         "ws": [None if g else data[8 * a:8 * (a + m)] for a, m, g in zip(first.tolist(), n.tolist(), gone[first].tolist())]})


_RUNS = "h long, k long, crc long, start int, n int, ws binary"


def repeats(docs: DataFrame, window: int, bits) -> DataFrame:
    """k, crc, start, n: runs of windows whose word sequence starts earlier. A task first compares
    what it has itself, so a passage that very many documents share leaves a task once; what it
    can't settle meets the same minimiser of other tasks."""
    size = 1 << WIDTH_BITS

    def settled(held):
        h, w, k, crc, start = (np.concatenate(x) for x in zip(*held))
        return _rows(h, w, k, crc, start, _judge(h, w, k, start))

    def run(frames):
        table, held, n_held = np.frombuffer(bits.value, np.uint8), [], 0
        for pdf in _news(frames):
            _, n, hashes, doc_of = _batch(pdf["text"], window)
            grams, least, inside = minimisers(hashes, doc_of, window)
            maybe = inside.copy()
            for row in range(DEPTH):
                c = _cells(least, row) + row * size
                maybe &= (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(maybe)
            if len(at):
                of = doc_of[at]
                held.append((as_long(least[at]), as_long(rolling(hashes, window, MIX2)[at]), pdf["doc_id"].to_numpy()[of], pdf["crc"].to_numpy()[of], at - (np.cumsum(n) - n)[of]))
                n_held += len(at)
            if n_held >= COMPARED:
                yield settled(held)
                held, n_held = [], 0
        if held:
            yield settled(held)

    def meet(frames):
        for pdf in by_key(frames, ["h"]):
            done = pdf["ws"].isna()
            yield pdf.loc[done, ["k", "crc", "start", "n"]]
            pdf = pdf[~done]
            if not len(pdf):
                continue
            n = pdf["n"].to_numpy()
            row = np.repeat(np.arange(len(pdf)), n)
            start = pdf["start"].to_numpy().astype(np.int64)[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
            k = pdf["k"].to_numpy()[row]
            gone = np.flatnonzero(_judge(pdf["h"].to_numpy()[row], np.frombuffer(b"".join(pdf["ws"]), np.int64), k, start))
            first, m = ranges(start[gone], row[gone])
            at = gone[first]
            yield pd.DataFrame({"k": k[at], "crc": pdf["crc"].to_numpy()[row[at]], "start": start[at].astype(np.int32), "n": m.astype(np.int32)})

    return docs.mapInPandas(run, _RUNS).repartition("h").sortWithinPartitions("h").mapInPandas(meet, "k long, crc long, start int, n int")


def covered(starts: np.ndarray, ns: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows that start at starts, starts + 1, ... (ns of them)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + ns + window - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by one space."""
    spark = docs.sparkSession
    base = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text", F.crc32(F.encode("text", "UTF-8")).alias("crc"))
    known = written(profiles(base).filter(F.col("n_words") >= window), "profiles")
    firsts = known.groupBy("sha").agg(F.min("doc_id").alias("first"))
    copies = known.join(firsts, "sha").filter("doc_id > first").select(F.col("doc_id").alias("k"), "crc", F.lit(-1).alias("start"), F.lit(0).alias("n"))
    bits = spark.sparkContext.broadcast(sketch(base, window))
    marks = repeats(base, window, bits).union(copies).groupBy("k", "crc").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))

    def run(frames):
        for pdf in pages(frames):
            rows = []
            for doc, text, starts, ns in zip(pdf["doc_id"], pdf["text"], pdf["starts"], pdf["ns"]):
                words = kept = words_of(text)
                if starts is not None and len(starts):
                    starts = np.asarray(starts, np.int64)
                    gone = np.ones(len(words), bool) if starts.min() < 0 else covered(starts, np.asarray(ns, np.int64), window, len(words))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                rows.append((None if doc == _NULL_ID else doc, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"]).astype({"doc_id": "Int64"})

    joined = base.join(marks.withColumnRenamed("crc", "c"), (F.col("doc_id") == F.col("k")) & (F.col("crc") == F.col("c")), "left")
    return joined.select("doc_id", "text", "starts", "ns").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")
