"""Connected components of a graph as Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it reaches.

    Alternates the large-star and small-star steps until nothing changes; rounds grow with the
    logarithm of the graph. A node of very many links is a group that is only reduced by min."""
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(down.select("a", F.col("m").alias("b")))
        new = checkpointed(small.distinct())
        # both step and result list every link once, so equal counts and sums of hashes mean no change
        if _state(new) == _state(e):
            break
        e = new
    return new.union(new.select("b", "b")).distinct().toDF("node", "component")


def _state(e: DataFrame):
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(r)
