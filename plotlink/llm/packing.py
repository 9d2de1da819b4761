"""Packing by cutting-stock column generation.

A document's tokens are cut into full sequences and a rest. The rests' lengths, rounded up to a
grid, form a histogram; a linear program over patterns (how many rests of each class fill one
sequence) is solved by column generation, a knapsack dynamic program pricing new patterns. Patterns
are rounded down, what is left over is packed first-fit decreasing, and both are assigned to the
documents by their rank within their class. Only the histogram and the patterns, whose sizes the
grid bounds, pass through the driver.

Defined cases: a null or empty text is its end token alone; repeated rows are packed each; very long
texts give many full sequences; an empty table gives no rows. Sequences are padded to the given
length, except those whose length is a power of two."""

import base64
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotlink.llm.common import id_and_text, pages, per_worker, written

#: What the rank library splits exactly as the tokenizer does: Latin text in runs that are not very
#: long, without a special token. Other texts go to the tokenizer itself, which is slower.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f\u2013\u2014\u2018-\u201e\u2026]*")
_LONG_RUN = re.compile(r"\S{300}|\s{300}")


class Encoder:
    """Token ids of texts as bytes of unsigned 32-bit values. ``ranks``: the same vocabulary as a rank
    file, and its pattern; it is the faster way to the same ids."""

    def __init__(self, path: str, ranks: tuple | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.quick = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})

    def one(self, text: str) -> bytes:
        if self.quick and _PLAIN.fullmatch(text) and "<|" not in text and not _LONG_RUN.search(text):
            return np.array(self.quick.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, grid: int, ranks: tuple | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and its class: 0 for a
    full sequence, else the length in grid units, rounded up; with part and rank, by which the piece
    can be numbered within its class."""
    step, end = size * 4, np.array([end_id], "<u4").tobytes()

    def run(frames):
        from pyspark import TaskContext

        encoder, part, numbers = per_worker(f"encoder:{tokenizer_path}:{ranks}", lambda: Encoder(tokenizer_path, ranks)), TaskContext.get().partitionId(), {}
        for pdf in pages(frames):
            rows = []
            for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                ids = encoder.one(text) + end
                for at in range(0, len(ids), step):
                    cut = ids[at:at + step]
                    kind = 0 if len(cut) == step else -(-len(cut) // (4 * grid))
                    rank = numbers.get(kind, 0)
                    numbers[kind] = rank + 1
                    rows.append((doc, at // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4, kind, part, rank))
            yield pd.DataFrame(rows, columns="doc_id start length ids_crc32 doc_tokens kind part rank".split()).astype({"doc_id": "Int64"})

    return id_and_text(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, part int, rank long")


def best_pattern(values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how many of each size 1..len(values) are worth most."""
    n = len(values)
    worth, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(n, room)
        tried = values[:k] + worth[room - 1::-1][:k]
        best = int(np.argmax(tried))
        if tried[best] > worth[room - 1]:
            worth[room], pick[room] = tried[best], best + 1
        else:
            worth[room], pick[room] = worth[room - 1], 0
    counts, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if pick[room]:
            counts[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return counts


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row exchange: small, and free of the threads of a BLAS library."""
    n = len(a)
    m = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        p = i + int(np.argmax(np.abs(m[i:, i])))
        m[[i, p]] = m[[p, i]]
        m[i] /= m[i, i]
        factor = m[:, i].copy()
        factor[i] = 0
        m -= np.outer(factor, m[i])
    return m[:, n:]


def cutting_stock(demand: np.ndarray, capacity: int, gap: float = 0.002) -> list:
    """[(pattern, sequences)] for the demand of sizes 1..len(demand), near the fewest sequences.

    Revised simplex over the master program: start with sequences of one size, price with the
    duals, and exchange a basis column while a pattern worth over one sequence exists. The duals
    over the best pattern's worth bound the optimum from below, so it ends within ``gap`` of it."""
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1.0 / (capacity // sizes)), demand[sizes - 1] / (capacity // sizes)
    for turn in range(60 * m + 200):
        if turn % 100 == 99:
            inverse = inverted(basis)
            x = np.maximum((inverse * demand[sizes - 1]).sum(axis=1), 0)
        duals = np.zeros(capacity)
        duals[sizes - 1] = np.maximum(inverse.sum(axis=0), 0)
        column = best_pattern(duals, capacity)[sizes - 1].astype(float)
        if column @ duals[sizes - 1] <= 1 + gap:
            break
        way = (inverse * column).sum(axis=1)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        x = x - ratio[leave] * way
        x[leave] = ratio[leave]
        x = np.maximum(x, 0)
        basis[:, leave] = column
        row = inverse[leave] / way[leave]
        inverse = inverse - np.outer(way, row)
        inverse[leave] = row
    left, plan = demand.copy(), []
    for j in np.argsort(-x, kind="stable"):
        pattern = np.zeros(len(demand), np.int64)
        pattern[sizes - 1] = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(np.floor(x[j] + 1e-6)), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((pattern, times))
            left = left - times * pattern
    return plan + leftovers(left, capacity)


def leftovers(left: np.ndarray, capacity: int) -> list:
    """First-fit decreasing for the few that rounding leaves: at most a pattern's worth for each class."""
    plan, left = [], left.copy()
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), capacity
        for size in range(len(left), 0, -1):
            if left[size - 1] and size <= room:
                n = min(int(left[size - 1]), room // size)
                pattern[size - 1], room = n, room - n * size
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left = left - times * pattern
    return plan


def slots(plan: list) -> dict:
    """For each class, arrays: first rank, first sequence, how many in a sequence, order in the sequence."""
    out, base = {}, 0
    given = {}
    for pattern, times in plan:
        order = 0
        for kind in np.flatnonzero(pattern)[::-1] + 1:
            n = int(pattern[kind - 1])
            out.setdefault(int(kind), []).append((given.get(kind, 0), base, n, order))
            given[kind] = given.get(kind, 0) + n * times
            order += n
        base += times
    return {k: np.array(v, np.int64).T for k, v in out.items()}


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, grid: int = 16, ranks: tuple | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Pieces with sequence_id and offset. Rests never share a sequence with a full one."""
    cut = written(pieces(docs, tokenizer_path, end_id, size, grid, ranks, id_col, text_col), "pieces")
    sizes = cut.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    capacity = size // grid
    histogram = {r["kind"]: r["n"] for r in sizes.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a row for each class at most
    demand = np.array([histogram.get(k, 0) for k in range(1, capacity + 1)], np.int64)
    plan = cutting_stock(demand, capacity)
    table, rests = slots(plan), sum(times for _, times in plan)

    def place(frames):
        for pdf in frames:
            kind, rank = pdf["kind"].to_numpy(), pdf["number"].to_numpy()
            seq, order = rests + rank, np.zeros(len(pdf), np.int64)
            for k in np.unique(kind[kind > 0]):
                at = np.flatnonzero(kind == k)
                start, base, n, place_ = table[int(k)][:, np.searchsorted(table[int(k)][0], rank[at], side="right") - 1]
                seq[at], order[at] = base + (rank[at] - start) // n, place_ + (rank[at] - start) % n
            yield pdf.drop(columns=["number", "kind"]).assign(sequence_id=seq, place=order)

    numbered = cut.join(first, ["kind", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", (F.col("first") + F.col("rank")).alias("number"))
    placed = numbered.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    here = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(here), F.lit(0)).alias("offset"))
