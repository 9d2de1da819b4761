"""Exact order statistics that stay small for hot groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions.lineage import written


def pick_at(df: DataFrame, by: list[str], value: str, index: Column, out: str) -> DataFrame:
    """The element at a zero-based ``index`` (an expression over the group size ``n``) of each
    group's ascending values. Values are counted before they are ordered, so callers round
    them first and a group costs its distinct values, not its rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    cum = counts.withColumns({
        "_cum": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.sum("_c").over(Window.partitionBy(*by)),
    })
    return cum.filter(F.col("_cum") > index).groupBy(*by).agg(F.min(value).alias(out), F.first("n").alias("n"))


def picks_at(df: DataFrame, by: list[str], value: str, index: dict[str, Column]) -> DataFrame:
    """Several elements of each group at once, like ``pick_at``; ``index``: output column -> index below ``n``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value)
    cum = counts.withColumns({
        "_cum": F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.sum("_c").over(Window.partitionBy(*by)),
    })
    return cum.groupBy(*by).agg(*[F.min(F.when(F.col("_cum") > i, F.col(value))).alias(out) for out, i in index.items()], F.first("n").alias("n"))


def pick_global(df: DataFrame, value: str, width: float, index: Column, out: str) -> DataFrame:
    """The element at a zero-based ``index`` (over ``n``) of all ascending values, as one row; none of no values.
    Bins of ``width`` are counted first, then only the values of the bin that holds the element."""
    of = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_bin"))
    bins = of.groupBy("_bin").agg(F.count("*").alias("_c"))
    cum = bins.withColumns({"_upto": F.sum("_c").over(Window.orderBy("_bin")), "n": F.sum("_c").over(Window.partitionBy())})  # as many rows as bins
    at = cum.filter(F.col("_upto") > index).orderBy("_bin").limit(1).select("_bin", (F.col("_upto") - F.col("_c")).alias("_before"), "n")
    inner = of.join(F.broadcast(at), "_bin").groupBy("_v", "_before", "n").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.orderBy("_v"))
    return inner.withColumn("_upto", upto).filter(F.col("_upto") > index).agg(F.min("_v").alias(out))


def ranked(df: DataFrame, by: list[str], keys: list[str], out: str = "rank") -> DataFrame:
    """Row number of every row within its group, for groups of any size: rows are range
    partitioned by group and keys, each range is numbered on its own, and the ranges' sizes
    give the offsets. The partitioned rows are written first, so both steps see the same."""
    parts = written(df.repartitionByRange(*by, *keys).withColumn("_pid", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy(*by, "_pid").agg(F.count("*").alias("_n")) \
        .select(*by, "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*by, "_pid").orderBy(*keys)
    return parts.join(base, [*by, "_pid"]).withColumn(out, (F.col("_base") + F.row_number().over(here)).cast("int")).drop("_pid", "_base")
