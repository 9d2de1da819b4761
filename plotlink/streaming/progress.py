"""Field progress: newest change per grave wins, in batch and as a stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = ["ts", "st", "note", "tombstone", "photo", "up"]


def _newest(ties: str) -> Column:
    """Later arrivals win equal times on the server and on import; on a device the entry
    that was there first stays."""
    arrival = F.col("arrival") if ties == "incoming" else -F.col("arrival")
    return F.max_by(F.struct(*VALUES, "arrival"), F.struct(F.col("ts"), arrival))


def merge_progress(changes: DataFrame, ties: str = "incoming") -> DataFrame:
    """Newest change per grave. Works on batches and, as a stateful aggregation whose state
    is one row per grave, on streams. Tombstones stay, so that removals travel too."""
    return changes.groupBy("pk").agg(_newest(ties).alias("v")).select("pk", "v.*")


def merge_into(state: DataFrame, incoming: DataFrame, ties: str = "incoming") -> DataFrame:
    return merge_progress(state.unionByName(incoming), ties)


def active(progress: DataFrame) -> DataFrame:
    return progress.filter(~F.coalesce("tombstone", F.lit(False)))


def run_merge_stream(changes: DataFrame, out: str, checkpoint: str, ties: str = "incoming", fold_every: int = 16) -> DataFrame:
    """Runs a change stream to its present end and gives the state.

    A micro-batch writes the newest change of each of its graves under its own epoch, so a replayed batch
    overwrites only itself. Epochs lie in groups of ``fold_every``; the batch that fills a group folds it,
    with the state before it, into one row a grave. The state is read from the last fold and the open
    group, so reading costs the live graves and at most ``fold_every`` batches, however long the stream."""
    log = FoldedLog(changes, out, ties, fold_every)
    q = changes.writeStream.foreachBatch(log.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return log.state()


class FoldedLog:
    """Keyed state as written tables: ``fold`` (a row a grave up to a group's end), ``delta`` (batches of a group),
    ``folded`` (which groups have been folded)."""

    def __init__(self, changes: DataFrame, out: str, ties: str, fold_every: int):
        self.spark, self.out, self.ties, self.every = changes.sparkSession, out, ties, fold_every
        self.empty = self.spark.createDataFrame([], merge_progress(self.spark.createDataFrame([], changes.schema)).schema)
        self.empty.write.mode("ignore").parquet(self._fold(-1))
        self._open(0, "ignore")
        self._told(-1).write.mode("ignore").parquet(f"{out}/folded/start")

    def _fold(self, group: int) -> str:
        return f"{self.out}/fold/group{group:06d}"

    def _open(self, group: int, mode: str) -> None:
        self.empty.write.mode(mode).parquet(f"{self.out}/delta/group{group:06d}/start")

    def _told(self, group: int) -> DataFrame:
        return self.spark.range(1).select(F.lit(group).alias("group"))

    def _read(self, path: str, nested: bool = False) -> DataFrame:
        return self.spark.read.schema(self.empty.schema).option("recursiveFileLookup", nested).parquet(path)

    def _merged(self, group: int) -> DataFrame:
        """The fold before a group with what the group has so far."""
        return merge_into(self._read(self._fold(group - 1)), self._read(f"{self.out}/delta/group{group:06d}", True), self.ties)

    def add(self, batch: DataFrame, epoch: int) -> None:
        group = epoch // self.every
        merge_progress(batch, self.ties).write.mode("overwrite").parquet(f"{self.out}/delta/group{group:06d}/epoch{epoch:09d}")
        if epoch % self.every == self.every - 1:
            self._merged(group).write.mode("overwrite").parquet(self._fold(group))
            self._open(group + 1, "overwrite")
            self._told(group).write.mode("overwrite").parquet(f"{self.out}/folded/group{group:06d}")

    def state(self) -> DataFrame:
        told = self.spark.read.schema("group int").option("recursiveFileLookup", True).parquet(f"{self.out}/folded")
        return self._merged(told.agg(F.max("group")).first()[0] + 1)


def backup_restore(current: DataFrame, backup: DataFrame) -> DataFrame:
    """A backup's entries win from equal times on; everything else stays."""
    both = current.withColumn("_b", F.lit(0)).unionByName(backup.withColumn("_b", F.lit(1)))
    return both.groupBy("pk").agg(F.max_by(F.struct(*VALUES, "arrival", "_b"), F.struct("ts", "_b", "arrival")).alias("v")) \
        .select("pk", "v.ts", "v.st", "v.note", "v.tombstone", "v.photo", "v.up", (F.col("v._b") == 1).alias("from_backup"))


def backup_updates(updates: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Dataset updates of a backup: per cemetery, accepted when the cemetery is known and
    every row has its key."""
    per = updates.groupBy("cem_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("mid").isNull()).alias("n_bad"))
    return per.join(cemetery.select("cem_id", F.lit(True).alias("known")), "cem_id", "left").select(
        "cem_id", "n_rows", "n_bad", (F.coalesce("known", F.lit(False)) & (F.col("n_bad") == 0)).alias("accepted"))


def request_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two request snapshots: what opened, what is still open, what vanished."""
    a = old.select("cem_id", "mid", F.lit(1).alias("_o")).distinct()
    b = new.select("cem_id", "mid", F.lit(1).alias("_n")).distinct()
    return a.join(b, ["cem_id", "mid"], "full_outer").select(
        "cem_id", "mid", F.when(F.col("_o").isNull(), "opened").when(F.col("_n").isNull(), "vanished").otherwise("open").alias("state"))
