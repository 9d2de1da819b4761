"""Saved pins re-anchor their cemetery while the stream runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotlink.operators.anchors import anchor_clusters, fit_walk_rows, gps_anchors
from plotlink.operators.maintain import latest_pins, overlay_field_pins


def _overlaid(pins: DataFrame, memorial: DataFrame, register: DataFrame, cemetery: DataFrame):
    """Memorials of the pinned cemeteries with the pins laid over them, and pinned register rows."""
    last = latest_pins(pins, cemetery)
    mem = memorial.join(pins.select("cem_id").distinct(), "cem_id", "left_semi").withColumn("pk", F.col("mid").cast("string"))
    ros = last.filter(F.col("pk").startswith("ros:")).select("cem_id", F.substring("pk", 5, 99).try_cast("bigint").alias("key"), "lat", "lng")
    return overlay_field_pins(mem, last), register.join(ros, ["cem_id", "key"])


def refit_lots(pins: DataFrame, memorial: DataFrame, register: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Lot clusters of the cemeteries that have pins."""
    mem, ros = _overlaid(pins, memorial, register, cemetery)
    return anchor_clusters(gps_anchors(mem, ros, cemetery))


def refit_rows(pins: DataFrame, memorial: DataFrame, register: DataFrame, cemetery: DataFrame, linked: DataFrame, plat: DataFrame) -> DataFrame:
    """Walk-row placements of the cemeteries that have pins."""
    mem, ros = _overlaid(pins, memorial, register, cemetery)
    here = register.join(pins.select("cem_id").distinct(), "cem_id", "left_semi")
    return fit_walk_rows(here, linked, mem, ros, plat, cemetery)


def run_refit_stream(pins: DataFrame, refit, out: str, checkpoint: str) -> DataFrame:
    """Each micro-batch logs its pins and refits (``refit``: pins -> results) only the
    cemeteries it touches; a cemetery's newest epoch is its present state."""
    spark = pins.sparkSession
    # the log lies by epoch and cemetery, so a batch reads only the cemeteries it touches
    logged = lambda: spark.read.schema(T.StructType([*pins.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{out}/pins")

    def sink(batch: DataFrame, epoch: int):
        batch.write.partitionBy("cem_id").mode("overwrite").parquet(f"{out}/pins/epoch={epoch:08d}")
        log = logged()
        touched = log.filter(F.col("epoch") == epoch).select("cem_id").distinct()
        known = log.filter(F.col("epoch") <= epoch).drop("epoch").join(touched, "cem_id", "left_semi")
        refit(known).write.mode("overwrite").parquet(f"{out}/state/epoch={epoch:08d}")

    q = pins.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    # a cemetery whose newest refit placed nothing must not fall back on an older one
    last = logged().groupBy("cem_id").agg(F.max("epoch").alias("epoch"))
    return spark.read.parquet(f"{out}/state").join(last, ["cem_id", "epoch"]).drop("epoch")
