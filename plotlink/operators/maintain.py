"""Table maintenance: overlays, snapshots, guards, key repair, photo slots."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions import geo, plots
from plotlink.functions.frames import once
from plotlink.functions.lineage import written


def normalize_register(register: DataFrame, sg_blocks=()) -> DataFrame:
    """Puts register positions into the same key space as parsed plots: grave-numbered
    sections and blocks use the grave as lot, bare numbers become "Section N", and a
    row with a block or lot but no section goes to the '*' bucket."""
    e = F.lit("")
    df = once(register, {
        "section": F.coalesce("section", e), "sub": F.coalesce("sub", e),
        "block": plots.norm_block(F.col("block")),
        "lot": F.coalesce("lot", e), "grave": F.coalesce("grave", e),
    })
    single = (F.col("section") == C.SINGLE_GRAVE_SECTION) & (F.col("lot") == "") & (F.col("grave") != "")
    numbered = F.col("block").isin(*sg_blocks) & (F.col("grave") != "") & F.col("lot").isin("", "1") \
        if sg_blocks else F.lit(False)
    df = df.withColumn("_shift", single | numbered)
    df = df.withColumns({
        "lot": F.when(F.col("_shift"), F.col("grave")).otherwise(F.col("lot")),
        "grave": F.when(F.col("_shift"), e).otherwise(F.col("grave")),
    })
    section = F.when(F.col("section").rlike(r"^\d+$"), F.concat(F.lit("Section "), plots.strip_zeros(F.col("section")))) \
        .when((F.col("section") == "") & ((F.col("block") != "") | (F.col("lot") != "")), F.lit("*")) \
        .otherwise(F.col("section"))
    return once(df, {"section": section}).drop("_shift")


def latest_pins(pins: DataFrame, cemetery: DataFrame, max_m: float = 800) -> DataFrame:
    """Newest saved pin per person, dropped when it lies off the cemetery."""
    last = pins.groupBy("cem_id", "pk").agg(F.max_by(F.struct("lat", "lng"), F.struct("ts", "arrival")).alias("g")).select("cem_id", "pk", "g.*")
    cem = cemetery.select("cem_id", F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    return last.join(cem, "cem_id").filter(geo.haversine(F.col("lat"), F.col("lng"), F.col("_a"), F.col("_b")) <= max_m).drop("_a", "_b")


def overlay_field_pins(persons: DataFrame, pins: DataFrame) -> DataFrame:
    """A saved pin replaces the person's own position; ``field_pin`` says so."""
    g = pins.select("cem_id", "pk", F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    return persons.join(g, ["cem_id", "pk"], "left").withColumns({
        "lat": F.coalesce("_a", "lat"), "lng": F.coalesce("_b", "lng"), "field_pin": F.col("_a").isNotNull(),
    }).drop("_a", "_b")


def overlay_memorials(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates replace base rows of the same memorial and keep the first row's place."""
    both = base.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    cols = [c for c in base.columns if c not in ("cem_id", "mid", "ord")]
    return both.groupBy("cem_id", "mid").agg(
        F.max_by(F.struct(*cols), F.struct("_u", "ord")).alias("v"), F.min_by("ord", F.struct("_u", "ord")).alias("ord")) \
        .select("cem_id", "mid", "ord", "v.*")


def snapshot_replace(base: DataFrame, updates: DataFrame, presence: DataFrame, empty_counts: bool) -> DataFrame:
    """A cemetery's rows are replaced as a whole. ``presence`` lists the cemeteries for which
    an update arrived; where ``empty_counts`` is off, one without rows changes nothing."""
    given = presence.select("cem_id").distinct()
    if not empty_counts:
        given = given.join(updates.select("cem_id").distinct(), "cem_id", "left_semi")
    return base.join(given, "cem_id", "left_anti").unionByName(updates.join(given, "cem_id", "left_semi"))


def merge_registry(previous: DataFrame, fresh: DataFrame, pinned: list[int], cached_requests: DataFrame) -> DataFrame:
    """Fresh listing wins; older cemeteries stay only if pinned or with cached requests."""
    old = previous.join(fresh.select("cem_id"), "cem_id", "left_anti")
    keep = old.join(cached_requests.select("cem_id").distinct().withColumn("_c", F.lit(True)), "cem_id", "left") \
        .filter(F.col("cem_id").isin(*pinned) | F.col("_c")).drop("_c")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(keep.withColumn("origin", F.lit("kept")))


def shrink_guard(new_counts: DataFrame, prev_counts: DataFrame, ratio: float = 0.5, floor: int = 100) -> DataFrame:
    """Refuses a snapshot that came back too short. Both tables: cem_id, n; ``new_counts``
    also reported_total."""
    j = new_counts.join(prev_counts.select("cem_id", F.col("n").alias("n_prev")), "cem_id", "left")
    least = F.greatest(F.col("reported_total"), F.coalesce("n_prev", F.lit(0))) * ratio
    return j.select("cem_id", "n", "n_prev", "reported_total", (~((least > floor) & (F.col("n") < least))).alias("accepted"))


def stale_partitions(registry: DataFrame, stage_state: DataFrame, cadence_s: dict[str, int], now: int, force: bool = False) -> DataFrame:
    """Every cemetery and stage with whether it is due and why."""
    stages = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(v).alias("cadence")) for k, v in cadence_s.items()]))
    want = registry.select("cem_id", stages.alias("s")).select("cem_id", "s.*")
    j = want.join(stage_state.select("cem_id", "stage", "ts"), ["cem_id", "stage"], "left")
    reason = F.when(F.lit(force), "forced").when(F.col("ts").isNull(), "missing").when(F.lit(now) - F.col("ts") > F.col("cadence"), "stale")
    return j.select("cem_id", "stage", reason.isNotNull().alias("due"), reason.alias("reason"))


def missing_keys(cached: DataFrame, bounds: DataFrame, run: int = 10_000) -> DataFrame:
    """Register keys to probe (again): 1..max_key that are not cached, where misses beyond the
    last real key count as not cached. ``cached``: register, key, miss; ``bounds``: register,
    max_key. Keys are laid out in runs, so a long register is many rows, not one long array."""
    last = cached.groupBy("register").agg(F.coalesce(F.max(F.when(~F.col("miss"), F.col("key"))), F.lit(0)).alias("last"))
    known = cached.join(last, "register").filter(~F.col("miss") | (F.col("key") <= F.col("last"))).select("register", "key")
    runs = last.select("register").join(bounds.filter("max_key >= 1"), "register").select(
        "register", "max_key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("max_key").cast("bigint"), F.lit(run).cast("bigint"))).alias("first"))
    return runs.select("register", F.explode(F.sequence("first", F.least(F.col("first") + run - 1, F.col("max_key").cast("bigint")))).alias("key")) \
        .join(known, ["register", "key"], "left_anti")


MAX_PHOTO = 25 * 1024 * 1024


def assign_photo_slots(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Where each incoming photo goes. Same bytes at the asked slot are a retry; a free slot
    is taken as asked; other bytes move to the next free slot 1-99 in arrival order; with
    none left the photo is refused, as is anything empty, too large or not a JPEG.

    ``stored``: pk, slot, sha. ``incoming``: arrival, pk, slot, sha, size, magic (first two
    bytes in hex). Only the first 100 arrivals that need a slot can find one, so a grave
    with any number of uploads ranks no more than that."""
    bad = F.when(F.col("size") == 0, "empty").when(F.col("size") > MAX_PHOTO, "too large").when(F.lower("magic") != "ffd8", "not a jpeg")
    inc = incoming.withColumn("why", bad)
    good = inc.filter("why IS NULL")
    at = good.join(stored.select("pk", "slot", F.col("sha").alias("have")), ["pk", "slot"], "left")
    # among newcomers to one empty slot the first arrival takes it; its equals are retries
    first = at.filter("have IS NULL").groupBy("pk", "slot").agg(F.min_by("sha", "arrival").alias("won"), F.min("arrival").alias("won_at"))
    at = at.join(first, ["pk", "slot"], "left").withColumn(
        "state", F.when(F.col("have") == F.col("sha"), "retry").when(F.col("won_at") == F.col("arrival"), "as asked")
        .when(F.col("have").isNull() & (F.col("won") == F.col("sha")), "retry").otherwise("move"))
    # read five times below
    at = written(at.select("arrival", "pk", "slot", "have", "state"), "photo-states")
    used = stored.select("pk", "slot").unionByName(at.filter("have IS NULL").select("pk", "slot")).distinct()
    move = at.filter("state = 'move'")
    free = move.select("pk").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(99)))) \
        .join(used, ["pk", "slot"], "left_anti")
    free = free.withColumn("i", F.row_number().over(Window.partitionBy("pk").orderBy("slot"))).select("pk", "i", F.col("slot").alias("new_slot"))
    order = Window.partitionBy("pk").orderBy("arrival")
    head = move.withColumn("i", F.row_number().over(order)).filter("i <= 100").select("arrival", "i")
    moved = move.join(head, "arrival", "left").join(free, ["pk", "i"], "left") \
        .select("arrival", "pk", F.col("new_slot").alias("slot"), F.when(F.col("new_slot").isNull(), "no slot").otherwise("moved").alias("result"))
    kept = at.filter("state <> 'move'").select("arrival", "pk", "slot", F.col("state").alias("result"))
    refused = inc.filter("why IS NOT NULL").select("arrival", "pk", F.lit(None).cast("int").alias("slot"), F.col("why").alias("result"))
    return kept.unionByName(moved).unionByName(refused)
