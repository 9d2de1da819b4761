"""Where intermediate tables go, so that plans stay short and survive lost executors."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only for a local master that has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plotlink-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: short plan, column pruning and real size statistics. Its schema is known, so no job
    goes over the files for it."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint()
