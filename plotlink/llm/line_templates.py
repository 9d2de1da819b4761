"""Line deduplication by a log-template tree.

A line is parsed to a fixed depth: its number of tokens, then its leading tokens, with tokens that
hold a digit as a variable field. Below stand its templates: the line with those fields open, and
for each quarter of its further tokens the line with that quarter open as well, so lines that differ
in one field of words still meet. A template recurs when documents of many different makings hold
it; copies and near copies count as one making, known by smallest word hashes outside the line. There
are two ways to show it. In small groups the distinct values of one hash are compared with the
texts. They run out in large groups, so there the values of three hashes together make a class, and
the effective number of classes (texts squared over the sum of squared class sizes) is compared with
a fixed number: near copies fall into one large class however many they are, texts of their own into
ever more. A template with an open quarter also needs several fillings. Lines of recurring templates
are dropped wherever they stand.

Defined cases: lines without a token are kept and never counted; a null text is empty; repeated rows
count once and are judged alike; a null doc_id counts like any other; an empty table gives no rows. Words
and templates are told apart by 64-bit hashes, texts by doc_id and crc32."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm.common import BASE, MIX1, MIX2, as_long, free, id_and_text, mixed, pages, word_hashes, written

LEAD, BANDS = 2, 4
#: The hashes of a making: a word's hash as it is, and mixed with these.
SALTS = (MIX1, MIX2)
#: What stands for a token with a digit, and for a token that a line lacks.
FIELD, NONE = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"<*>", b""))
#: Bytes of text that are parsed at once; a longer text is parsed by itself.
PAGE = 1 << 22
_NULL_ID = -(1 << 63)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))


def others(least: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each line the smallest value of the other lines of its text; ``text`` numbers the texts of the lines,
    ``first`` is each text's first line. A line that is its text's only one gets the largest number."""
    low = np.minimum.reduceat(least, first)
    at = np.flatnonzero(least == low[text])
    at = at[np.unique(text[at], return_index=True)[1]]  # the first line that has it, of each text
    rest = least.copy()
    rest[at] = np.iinfo(np.uint64).max
    out = low[text]
    out[at] = np.minimum.reduceat(rest, first)[text[at]]
    return out


def parse(texts: list) -> dict | None:
    """Lines with a token of many texts at once: text (its place), line, leaf, maker, making and templates, as
    arrays. Every word is hashed once; a template is a sum of its words' hashes times powers of an odd
    number by place, so an open quarter is taken off the whole line's sum."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    signs = np.frombuffer(joined, np.uint8)
    space = _SPACE[signs]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(signs) else []
    if not len(starts):
        return None
    h = word_hashes(joined.split())
    line = np.searchsorted(np.flatnonzero(signs == 10), starts)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.concatenate([first, [len(h)]]))
    of = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(h)) - first[of]
    base = np.cumsum([0] + [r.count(b"\n") + 1 for r in raw])[:-1]
    text = np.searchsorted(base, line[first], "right") - 1
    text_first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    number = np.cumsum(np.concatenate([[0], text[1:] != text[:-1]]))

    with np.errstate(over="ignore"):
        making = np.zeros(len(first), np.uint64)
        for salt in (None, *SALTS):
            low = others(np.minimum.reduceat(h if salt is None else mixed(h + np.uint64(salt)), first), number, text_first)
            if salt is None:
                maker = low
            making = mixed(making * np.uint64(BASE) + low)
        alone = np.diff(np.concatenate([text_first, [len(first)]]))[number] == 1
        maker, making = (np.where(alone, np.uint64(0), x) for x in (maker, making))

        token = np.where(np.logical_or.reduceat(_DIGIT[signs], starts), FIELD, h)
        lead = [np.where(size > i, token[np.minimum(first + i, len(h) - 1)], NONE) for i in range(LEAD)]
        leaf = size.astype(np.uint64)
        for x in lead:
            leaf = mixed(leaf * np.uint64(BASE) + x)
        powers = np.cumprod(np.full(int(size.max()), np.uint64(MIX1), np.uint64))
        terms = token * powers[place]
        sums = np.add.reduceat(terms, first)
        templates = np.zeros((len(first), BANDS + 1), np.uint64)
        templates[:, 0] = mixed(sums + leaf)
        rest = size[of] - LEAD
        inner = np.flatnonzero((place >= LEAD) & (rest >= BANDS))
        if len(inner):
            # the quarters of a line's further tokens are as even as they can be
            quarter = of[inner] * BANDS + (BANDS * (place[inner] - LEAD + 1) - 1) // rest[inner]
            edge = np.flatnonzero(np.concatenate([[True], quarter[1:] != quarter[:-1]]))
            at, band = quarter[edge] // BANDS, quarter[edge] % BANDS
            templates[at, band + 1] = mixed(mixed(sums[at] - np.add.reduceat(terms[inner], edge) + leaf[at]) + (band + 1).astype(np.uint64))
    return {"text": text, "line": line[first] - base[text], "leaf": leaf, "maker": maker, "making": making, "templates": templates, "banded": size - LEAD >= BANDS}


def pieces(pdf: pd.DataFrame):
    """Slices of a frame with about PAGE characters of text each."""
    at = size = 0
    for i, n in enumerate(pdf["text"].str.len()):
        if i > at and size + n > PAGE:
            yield pdf.iloc[at:i]
            at, size = i, 0
        size += n
    yield pdf.iloc[at:]


def parsed(docs: DataFrame) -> DataFrame:
    """One row for each line with a token: doc_id, crc of the text, line, leaf, maker, making, templates."""
    def run(frames):
        for page in pages(frames):
            for pdf in pieces(page):
                got = parse(list(pdf["text"]))
                if got is None:
                    continue
                rows = as_long(got["templates"])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[got["text"]], "crc": pdf["crc"].to_numpy()[got["text"]], "line": got["line"].astype(np.int32),
                                    "leaf": as_long(got["leaf"]), "maker": as_long(got["maker"]), "making": as_long(got["making"]),
                                    "templates": [r if b else r[:1] for r, b in zip(rows, got["banded"])]})

    return docs.mapInPandas(run, "doc_id long, crc long, line int, leaf long, maker long, making long, templates array<long>")


def recurring(lines: DataFrame, least: int, share: float, fillings: int) -> DataFrame:
    """doc_id, crc and the numbers of the lines whose template recurs. Lines go on only while they can: by their
    leaf's makings, then by their template's lines. A text counts once for a template, by its smallest
    values; values are counted first and templates after, so a template that a third of all texts hold is
    counted by many tasks."""
    key = ["template", "band"]
    leaves = lines.select("leaf", "making").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("leaf")
    able = written(lines.join(leaves, "leaf").select("doc_id", "crc", "line", "maker", "making", "templates"), "able")
    heavy = able.select(F.posexplode("templates").alias("band", "template")).groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(*key)
    below = able.select("doc_id", "crc", "line", "maker", "making", F.col("templates")[0].alias("whole"), F.posexplode("templates").alias("band", "template"))
    below = written(below.join(heavy, key), "below")
    texts = below.groupBy(*key, "crc").agg(*[F.min(c).alias(c) for c in ("maker", "making", "whole")])
    values = texts.select(*key, F.posexplode(F.array("maker", "making", "whole")).alias("kind", "value")).groupBy(*key, "kind", "value").agg(F.count("*").cast("double").alias("size"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0.0))
    counted = values.groupBy(*key).agg(of(0, F.lit(1.0)).alias("makers"), of(0, F.col("size")).alias("texts"), of(1, F.col("size") * F.col("size")).alias("squares"), of(2, F.lit(1.0)).alias("fillings"))
    small = (F.col("makers") >= least) & (F.col("makers") >= share * F.col("texts"))
    many = F.col("texts") * F.col("texts") >= least * F.col("squares")  # texts squared over the squared classes: their effective number
    often = counted.filter((small | many) & ((F.col("band") == 0) | (F.col("fillings") >= fillings)))
    gone = below.select("doc_id", "crc", "line", *key).join(often.select(*key), key).select("doc_id", "crc", "line").distinct()
    return gone.groupBy("doc_id", "crc").agg(F.collect_set("line").alias("gone"))


def dropped_lines(docs: DataFrame, least: int = 10, share: float = 0.3, fillings: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, crc and the line numbers to drop. ``least``: makings that a template needs; ``share``:
    of the different texts that hold it, how many must differ in making, unless its effective number
    of makings is ``least``."""
    base = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "text", _crc("text").alias("crc"))
    return recurring(written(parsed(base), "lines"), least, share, fillings)


def _crc(text: str):
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple = ()) -> DataFrame:
    """The documents, all columns, less the dropped lines; ``counts`` names two more columns, for the
    lines there were and those dropped."""
    key, crc, at = (free(docs, x) for x in ("_key", "_crc", "_at"))
    of = gone.select(F.col("doc_id").alias(key), F.col("crc").alias(crc), F.col("gone").alias(at))
    rows = docs.join(of, (F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)) == F.col(key)) & (_crc(text_col) == F.col(crc)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(at), i)), "\n")
    for name, n in zip(counts, (F.size(lines), F.size(at))):
        rows = rows.withColumn(name, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long"))
    return rows.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(kept)).drop(key, crc, at)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return without(base, dropped_lines(base, **options), counts=("n_lines", "n_dropped")).select("doc_id", "n_lines", "n_dropped", "text")
