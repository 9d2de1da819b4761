"""Helpers of the operators: words, hashes, small tables, values that a worker keeps."""

import sys
import types
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.functions.lineage import checkpointed, shared_root, written  # noqa: F401

#: Odd 64-bit multipliers of the rolling and mixing hashes.
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the input has; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def per_worker(key, make):
    """What ``make`` gives, kept by a Python worker from one task to the next."""
    kept = sys.modules.setdefault("_plotlink_llm_kept", types.ModuleType("_plotlink_llm_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words_of(text) -> list:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: bytes split at exactly these six."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix finisher over unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Mixed hash of every k consecutive values; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(base) + h[j:j + n]
    return mixed(out)


def shingle_set(words: list, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter sequence is one shingle, none is empty."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(k, len(words)), BASE + 2 * min(k, len(words))))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def pages(pdf_iter, rows: int = 256):
    """Smaller frames, so that a batch of very long texts stays within memory."""
    for pdf in pdf_iter:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at:at + rows]


def free(df: DataFrame, name: str) -> str:
    """``name``, longer if the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_hash(text: Column) -> Column:
    """What tells the texts of one id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """The documents, all columns, whose ``keys`` are no row of ``gone``, which has a column for each; nulls are equal."""
    names = [free(docs, f"_gone{i}_") for i in range(len(keys))]
    on = [key.eqNullSafe(F.col(name)) for key, name in zip(keys, names)]
    return docs.join(gone.toDF(*names).distinct(), on, "left_anti")


def numbered(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a column ``name``: the id, or where it is null or stands for several texts, a number of
    its own behind all ids for each of them, so that no row goes for another's text."""
    key, h = F.col(id_col).cast("long"), text_hash(F.col(text_col))
    several = written(docs.select(key.alias("id"), h.alias("h")).groupBy("id").agg((F.min("h") != F.max("h")).alias("x")).filter("id is null or x").select("id"), "several")
    odd = free(docs, "_several")
    rows = docs.join(several.withColumnRenamed("id", odd).filter(f"{odd} is not null"), key == F.col(odd), "left")
    # the highest bits mark such numbers; ids that are as large count as numbers themselves
    own = F.xxhash64(key, h).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(3 << 61))
    return rows.withColumn(name, F.when(key.isNull() | F.col(odd).isNotNull(), own).otherwise(key)).drop(odd)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def new_path(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def by_key(frames, key: list):
    """Frames of many whole groups each, of rows that arrive sorted by ``key``."""
    import pandas as pd

    held = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = pdf[key].iloc[-1].tolist()
        if held and held[-1][key].iloc[-1].tolist() == last and pdf[key].iloc[0].tolist() == last:
            held.append(pdf)  # still one group
            continue
        at = len(pdf)
        while at and pdf[key].iloc[at - 1].tolist() == last:
            at -= 1
        whole = pd.concat([*held, pdf.iloc[:at]])
        if len(whole):
            yield whole
        held = [pdf.iloc[at:]]
    if held:
        yield pd.concat(held)


def by_group(frames, key: list):
    """Whole groups, one frame each, of rows that arrive sorted by ``key``."""
    for pdf in by_key(frames, key):
        for _, group in pdf.groupby(key, sort=False, dropna=False):
            yield group


def ranges(at: np.ndarray, row: np.ndarray):
    """(first place, length) of runs of consecutive ``at`` within one ``row``; both in order."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(row) != 0)]))
    return first, np.diff(np.concatenate([first, [len(at)]]))
