"""The unified burial index and the questions asked of it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import geo, outline, plots
from plotlink.functions.lineage import written
from plotlink.operators.standardize import plot_keys

KEY = ["cem_id", "section", "group_sub", "group_block"]


def burial_union(memorial: DataFrame, register: DataFrame, linked: DataFrame) -> DataFrame:
    """Memorials and register rows with plot keys; ``hidden`` rows show through a memorial."""
    cols = ["cem_id", "kind", "id", "ord", "name", "by", "dy", "section", "sub", "block", "lot", "grave", "has_photo", "hidden"]
    mem = memorial.filter("section IS NOT NULL").withColumns({
        "kind": F.lit("mem"), "id": F.col("mid"), "has_photo": F.col("flags").bitwiseAND(1) != 0, "hidden": F.lit(False)})
    mark = linked.select("cem_id", "key", F.lit(True).alias("_l")).distinct()
    ros = register.filter("section <> ''").join(mark, ["cem_id", "key"], "left").withColumns({
        "kind": F.lit("ros"), "id": F.col("key"), "has_photo": F.lit(False), "hidden": F.coalesce("_l", F.lit(False))})
    return plot_keys(mem.select(*cols).unionByName(ros.select(*cols)))


def _lot_token(n: str, text: str) -> Column:
    return F.when(F.col(n).isNotNull(), F.concat(F.lit("n:"), F.col(n).cast("string"))) \
        .when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("t:"), F.col(text))).otherwise("e:")


def neighbors(target_plots: DataFrame, burials: DataFrame, max_lots: int = 3) -> DataFrame:
    """Burials within ``max_lots`` of each distinct target plot. The lot band becomes an equi
    join on at most ``2 * max_lots + 1`` lot numbers, so a burial meets a bounded number of
    plots and the result grows with the burials, not with their square."""
    t = plot_keys(target_plots.select("cem_id", "section", "sub", "block", "lot").filter("section <> ''").distinct())
    t = t.select(*KEY, "lot", "lot_n").distinct()
    band = F.when(F.col("lot_n").isNotNull(), F.transform(
        F.sequence(F.col("lot_n") - max_lots, F.col("lot_n") + max_lots), lambda x: F.concat(F.lit("n:"), x.cast("string")))) \
        .otherwise(F.array(_lot_token("lot_n", "lot")))
    t = t.withColumn("tok", F.explode(band))
    b = burials.filter("NOT hidden").withColumn("tok", _lot_token("lot_n", "lot")).select(
        *KEY, "tok", "kind", "id", "ord", "name", F.coalesce("grave", F.lit("")).alias("grave"), "has_photo", F.col("lot_n").alias("b_lot_n"))
    out = t.join(b, [*KEY, "tok"])
    dist = F.when(F.col("lot_n").isNotNull(), F.abs(F.col("b_lot_n") - F.col("lot_n"))).when(F.col("lot") != "", 0).otherwise(3)
    return out.withColumn("dist", dist.cast("int")).drop("tok", "b_lot_n", "lot_n")


def neighbor_pick(target: DataFrame, burials: DataFrame, cap: int = 14, photos: int = 5) -> DataFrame:
    """What a request's card shows: the nearest ``cap`` neighbours, of which the first
    ``photos`` photographed ones always stay. Each plot keeps one spare row of both kinds,
    because a request never lists itself."""
    order = [F.col("dist"), F.desc("has_photo"), F.col("grave"), F.when(F.col("kind") == "mem", 0).otherwise(1), F.col("ord")]
    plot = [*KEY, "lot"]
    n = written(neighbors(target, burials), "neighbors")  # ranked twice below
    w = Window.partitionBy(*plot).orderBy(*order)
    near = n.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap + 1)
    pics = n.filter("has_photo").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= photos + 1)
    few = written(near.drop("_r").unionByName(pics.drop("_r")).dropDuplicates([*plot, "kind", "id"]), "nearest")
    t = plot_keys(target.filter("section <> ''")).select("mid", *plot)
    mine = t.join(few, plot).filter((F.col("kind") != "mem") | (F.col("id") != F.col("mid")))
    wr = Window.partitionBy("cem_id", "mid").orderBy(*order)
    mine = mine.withColumn("_pic", F.when(F.col("has_photo"), F.sum(F.col("has_photo").cast("int")).over(wr)))
    mine = mine.withColumn("_keep", F.coalesce(F.col("_pic") <= photos, F.lit(False)))
    mine = mine.withColumn("_kept", F.sum(F.col("_keep").cast("int")).over(Window.partitionBy("cem_id", "mid"))) \
        .withColumn("_fill", F.when(~F.col("_keep"), F.sum((~F.col("_keep")).cast("int")).over(wr)))
    shown = mine.filter(F.col("_keep") | (F.col("_fill") <= cap - F.col("_kept")))
    return shown.withColumn("rank", F.row_number().over(wr)).select("cem_id", "mid", "kind", "id", "name", "dist", "has_photo", "rank")


def lot_occupants(plat: DataFrame, burials: DataFrame) -> DataFrame:
    """Everyone recorded in each drawn lot, in grave order (rows without a number last)."""
    cells = plot_keys(plat.select("cem_id", "section", "sub", "block", "lot").distinct()).withColumn(
        "lot_no", F.coalesce(F.col("lot_n").cast("string"), F.lit("NaN"))).select(*KEY, "sub", "block", "lot", "lot_no")
    b = burials.filter("NOT hidden").withColumn("lot_no", F.coalesce(F.col("lot_n").cast("string"), F.lit("NaN"))).select(
        *KEY, "lot_no", F.col("block").alias("q_block"), "kind", "id", "ord", "name", "grave")
    out = cells.join(b, [*KEY, "lot_no"]).filter((F.col("block") == "") | (F.col("q_block") == "") | (F.col("block") == F.col("q_block")))
    g = plots.int_prefix(F.col("grave"))
    return out.select("cem_id", "section", "sub", "block", "lot", "kind", "id", "name", "ord",
                      F.when(g != 0, g).otherwise(99).alias("grave_order"))


def nearest_cemetery(positions: DataFrame, cemetery: DataFrame, max_m: float = 1200) -> DataFrame:
    """Closest cemetery within ``max_m`` of each position. Each cemetery is filed under the
    cells its circle can touch, so positions meet it in an equi join on their own cell."""
    cell = 0.02
    dlat = max_m / 111000.0
    dlng = F.lit(dlat) / F.cos(F.radians("lat"))
    idx = lambda c: F.floor(c / cell).cast("int")
    cem = cemetery.select("cem_id", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"),
                          F.sequence(idx(F.col("lat") - dlat), idx(F.col("lat") + dlat)).alias("_ys"),
                          F.sequence(idx(F.col("lng") - dlng), idx(F.col("lng") + dlng)).alias("_xs"))
    cem = cem.withColumn("cy", F.explode("_ys")).withColumn("cx", F.explode("_xs")).drop("_ys", "_xs")
    pos = positions.withColumns({"cy": idx(F.col("lat")), "cx": idx(F.col("lng"))})
    j = pos.join(cem, ["cy", "cx"]).withColumn("dist_m", geo.haversine(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
    return j.filter(F.col("dist_m") <= max_m).groupBy("observer_id").agg(
        F.min_by("cem_id", F.struct("dist_m", "cem_id")).alias("cem_id"), F.min("dist_m").alias("dist_m"))


def out_of_bounds(entries: DataFrame, vertices: DataFrame, margin_m: float = 25) -> DataFrame:
    """Plat entries with ``outside``: farther than ``margin_m`` from every outline of their cemetery, and ``off_m``, the way
    to it: 0 inside, null where it is more than the margin. ``vertices``: cem_id, poly, v, lat, lng."""
    key = ["cem_id", "map_id", "ord"]
    edges = written(outline.edges_of(vertices, "poly"), "edges")
    points = entries.select(*key, "lat", "lng")
    within = written(outline.inside(points, edges, key), "inside").withColumn("_in", F.lit(True))
    near = written(outline.near_edge(points, edges, key, margin_m), "near-edge")
    known = vertices.select("cem_id").distinct().withColumn("_known", F.lit(True))
    out = entries.join(within, key, "left").join(near, key, "left").join(known, "cem_id", "left")
    off = F.when(F.col("_in"), 0.0).otherwise(F.col("dist_m"))
    return out.withColumn("off_m", off).withColumn("outside", F.coalesce(F.col("_known"), F.lit(False)) & F.col("off_m").isNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()).drop("_in", "dist_m", "_known")


def out_of_bounds_filter(entries: DataFrame, vertices: DataFrame, margin_m: float = 25) -> DataFrame:
    return out_of_bounds(entries, vertices, margin_m).filter("NOT outside").drop("outside", "off_m")


def fulfilled_requests(progress: DataFrame, request: DataFrame, memorial: DataFrame) -> DataFrame:
    """Finished work whose request is gone from the open list: most likely delivered."""
    done = progress.filter(F.col("st").isin("done", "nostone", "notfound") & F.col("pk").rlike(r"^\d+$")) \
        .withColumn("mid", F.col("pk").try_cast("bigint"))
    return done.join(request.select("mid"), "mid", "left_anti").join(memorial.select("mid", "cem_id", "name"), "mid") \
        .select("cem_id", "mid", "name", "st", "ts")


def person_by_pk(keys: DataFrame, memorial: DataFrame, register: DataFrame, linked: DataFrame) -> DataFrame:
    """The person behind a progress or photo key; the photo slot after ``#`` does not count."""
    k = keys.select("pk").distinct().withColumn("base", F.substring_index("pk", "#", 1))
    ros = k.filter(F.col("base").startswith("ros:")).withColumn("key", F.substring("base", 5, 99).try_cast("bigint"))
    label = F.concat_ws(" ", F.when(~F.col("section").isin("", "*"), F.col("section")), F.when(F.col("block") != "", F.concat(F.lit("Blk "), "block")),
                        F.when(F.col("lot") != "", F.concat(F.lit("Lot "), "lot")), F.when(F.col("grave") != "", F.concat(F.lit("Gr "), "grave")))
    by_reg = ros.join(register, "key").join(linked.select("cem_id", "key", "mid"), ["cem_id", "key"], "left") \
        .select("pk", "cem_id", "name", "by", "dy", "mid", label.alias("plot_text"))
    by_mem = k.filter(F.col("base").rlike(r"^\d+$")).withColumn("mid", F.col("base").try_cast("bigint")).join(memorial, "mid") \
        .select("pk", "cem_id", "name", "by", "dy", "mid", F.col("plot").alias("plot_text"))
    return by_mem.unionByName(by_reg)
