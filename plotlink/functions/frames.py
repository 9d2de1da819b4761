"""Small DataFrame helpers shared by the jobs."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Like ``withColumns``, but evaluated exactly once per row.

    A long chain of regular expressions would otherwise be substituted into every filter and
    projection above it, until the generated code no longer compiles. ``inline`` over a
    one-element array is a plan node the optimizer does not fold expressions through.
    """
    keep = [c for c in df.columns if c not in cols]
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select(*keep, made)


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
