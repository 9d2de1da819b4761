"""The evidence cascade from a plot to a place."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import geo, plots
from plotlink.functions.frames import union_all
from plotlink.functions.lineage import written
from plotlink.operators.anchors import BLOCK, anchor_clusters

PLOT = ["cem_id", "section", "sub", "block", "lot"]
LEVELS = ["gps", "lot", "adjacent", "block", "section", "family"]


def project_entries(plat_map: DataFrame, plat_entry: DataFrame) -> DataFrame:
    """Plat entries in local metres with the attributes of their map (affine maps are linear,
    so averages can be taken after the transform)."""
    m = plat_map.drop("cem_id")
    return plat_entry.join(m, "map_id").withColumns({"e": F.expr("a * x + b * y + c"), "n": F.expr("d * x + f * y + g")}) \
        .select("cem_id", "map_ord", "section", "sub", "style", "quality", "loo_median", "ord", "block", "lot", "e", "n")


def _plat_acc(bump: int):
    base = F.when(F.col("quality") == "good", F.greatest(F.coalesce(F.nullif("loo_median", F.lit(0.0)), F.lit(5.0)), F.lit(5.0))) \
        .when(F.col("quality") == "fair", 11.0).when(F.col("quality") == "approx", 14.0).otherwise(28.0)
    return geo.half_up(base + bump).cast("int")


def _keyed_entries(plat: DataFrame) -> DataFrame:
    """Entries under the block keys a query can ask for: its own block, any block of a map
    drawn by lots, or any block at all when the query names none."""
    lots = F.col("style") == "lots"
    keys = F.array(F.lit("any"), F.when(lots, F.lit("lots")).otherwise(F.concat(F.lit("b:"), F.col("block"))))
    return plat.withColumn("bkey", F.explode(keys)).withColumnRenamed("sub", "m_sub")


def _keyed_plots(p: DataFrame) -> DataFrame:
    keys = F.when(F.col("block") == "", F.array(F.lit("any"))).otherwise(F.array(F.lit("lots"), F.concat(F.lit("b:"), F.col("block"))))
    return p.withColumn("bkey", F.explode(keys))


def _sub_ok():
    return (F.col("section") != "Old Part") | (F.col("sub") == "") | (F.col("m_sub") == F.col("sub"))


def _tier(df: DataFrame, tier: int, level: str, src: str, acc, pins=None) -> DataFrame:
    return df.select(*PLOT, F.lit(tier).alias("tier"), "e", "n", acc.cast("int").alias("acc"), F.lit(level).alias("level"),
                     F.lit(src).alias("src"), (pins if pins is not None else F.lit(None)).cast("bigint").alias("pins"))


def _first_map(df: DataFrame) -> DataFrame:
    """The result of the first map that has one."""
    return df.groupBy(*PLOT).agg(F.min_by(F.struct("e", "n", "quality", "loo_median"), "map_ord").alias("f")).select(*PLOT, "f.*")


MAP = ["map_ord", "m_sub", "quality", "loo_median"]


def plat_exact(p: DataFrame, entries: DataFrame) -> DataFrame:
    """Drawn lot: exactly one entry, or exactly one in the query's own block."""
    cells = entries.groupBy("cem_id", "section", "bkey", "block", "lot", *MAP).agg(
        F.count("*").alias("c"), F.min("e").alias("e"), F.min("n").alias("n")).withColumnRenamed("block", "e_block")
    q = _keyed_plots(p).withColumn("_lot", plots.canonical_lot(F.col("lot")))
    hit = q.join(cells.withColumnRenamed("lot", "_lot"), ["cem_id", "section", "bkey", "_lot"]).filter(_sub_ok())
    own = (F.col("block") != "") & (F.col("e_block") == F.col("block"))
    g = hit.groupBy(*PLOT, *MAP).agg(
        F.sum("c").alias("hits"), F.sum(F.when(own, F.col("c")).otherwise(0)).alias("own"),
        F.min(F.struct("e", "n")).alias("any"), F.min(F.when(own, F.struct("e", "n"))).alias("mine"))
    g = g.withColumn("at", F.when(F.col("hits") == 1, F.col("any")).when(F.col("own") == 1, F.col("mine"))) \
        .filter("at IS NOT NULL").select(*PLOT, *MAP, "at.*")
    return _tier(_first_map(g), 1, "lot", "plat", _plat_acc(0))


def plat_adjacent(p: DataFrame, entries: DataFrame) -> DataFrame:
    """Up to three nearest drawn lots of the block, none farther than six, one within four."""
    num = entries.withColumn("lot_i", plots.int_prefix(F.col("lot"))).filter("lot_i IS NOT NULL")
    group = ["cem_id", "section", "bkey", *MAP]
    enough = num.groupBy(*group).agg(F.count("*").alias("c")).filter("c >= 2").drop("c")
    # three entries per lot number are all a query can use
    w = Window.partitionBy(*group, "lot_i").orderBy("ord")
    few = num.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").join(enough, group, "left_semi") \
        .select(*group, "lot_i", "ord", "e", "n")
    q = _keyed_plots(p.filter("lot_n IS NOT NULL")).withColumn("lot_i", F.explode(F.expr("sequence(lot_n - 6, lot_n + 6)")))
    # spread plots are many times the size of their table, which is all Spark sees of them: they are never broadcast
    near = q.join(few.hint("merge"), ["cem_id", "section", "bkey", "lot_i"]).filter(_sub_ok()).withColumn("d", F.abs(F.col("lot_i") - F.col("lot_n")))
    w = Window.partitionBy(*PLOT, *MAP).orderBy("d", "ord")
    near = near.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").withColumn("w", 1.0 / (1 + F.col("d")))
    g = near.groupBy(*PLOT, *MAP).agg(F.min("d").alias("dmin"), *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("e", "n")])
    return _tier(_first_map(g.filter("dmin <= 4")), 3, "adjacent", "plat", _plat_acc(4))


def plat_block(p: DataFrame, plat: DataFrame) -> DataFrame:
    cells = plat.withColumnRenamed("sub", "m_sub").groupBy("cem_id", "section", "block", *MAP).agg(
        F.count("*").alias("c"), F.avg("e").alias("e"), F.avg("n").alias("n")).filter("c >= 2")
    g = p.filter("block <> ''").join(cells, ["cem_id", "section", "block"]).filter(_sub_ok())
    return _tier(_first_map(g), 5, "block", "plat", _plat_acc(14))


def anchor_lot(p: DataFrame, clusters: DataFrame) -> DataFrame:
    q = p.filter("lot <> ''").withColumn("lot_key", plots.canonical_lot(F.col("lot")))
    g = q.join(clusters, ["cem_id", "section", "sub", "block", "lot_key"])
    floor = F.when(F.col("pins") == 1, 10.0).otherwise(6.0)
    acc = geo.half_up(F.least(F.lit(18.0), F.greatest(floor, floor + F.round(F.col("spread"), 6) / 2)))
    return _tier(g, 2, "lot", "anchors", acc, F.col("pins"))


def anchor_adjacent(p: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters one to three lots away, widening only until two are found."""
    steps = F.array(*[F.lit(d) for d in (-1, 1, -2, 2, -3, 3)])
    q = p.filter("lot_n IS NOT NULL").withColumn("step", F.explode(steps)) \
        .withColumn("lot_key", (F.col("lot_n") + F.col("step")).cast("string")).withColumn("d", F.abs("step"))
    hit = q.join(clusters.hint("merge"), ["cem_id", "section", "sub", "block", "lot_key"])
    within = lambda k: F.col("d") <= k
    g = hit.groupBy(*PLOT).agg(
        F.count_if(within(1)).alias("n1"), F.count_if(within(2)).alias("n2"),
        *[agg.alias(f"{name}{k}") for k in (1, 2, 3) for name, agg in {
            "w": F.sum(F.when(within(k), 1.0 / (1 + F.col("d")))),
            "e": F.sum(F.when(within(k), F.col("e") / (1 + F.col("d")))),
            "n_": F.sum(F.when(within(k), F.col("n") / (1 + F.col("d")))),
            "p": F.sum(F.when(within(k), F.col("pins"))),
        }.items()])
    pick = lambda c: F.when(F.col("n1") >= 2, F.col(f"{c}1")).when(F.col("n2") >= 2, F.col(f"{c}2")).otherwise(F.col(f"{c}3"))
    g = g.select(*PLOT, (pick("e") / pick("w")).alias("e"), (pick("n_") / pick("w")).alias("n"), pick("p").alias("pins"))
    return _tier(g, 4, "adjacent", "anchors", F.when(F.col("pins") > 1, 14).otherwise(17), F.col("pins"))


def anchor_block(p: DataFrame, anchor: DataFrame) -> DataFrame:
    c = anchor_clusters(anchor.filter("block <> ''"), BLOCK).filter("n_all >= 2")
    g = p.filter("block <> ''").join(c, BLOCK)
    acc = geo.half_up(F.least(F.lit(45.0), F.greatest(F.lit(18.0), 15 + F.round(F.col("spread"), 6) / 2)))
    return _tier(g, 6, "block", "anchors", acc, F.col("pins"))


def section_area(p: DataFrame, section: DataFrame, cemetery: DataFrame) -> DataFrame:
    cem = cemetery.select("cem_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    s = section.join(cem, "cem_id").select(
        "cem_id", "section", geo.east(F.col("lng"), F.col("clat"), F.col("clng")).alias("e"),
        geo.north(F.col("lat"), F.col("clat")).alias("n"), "radius")
    return _tier(p.join(s, ["cem_id", "section"]), 7, "section", "section", F.coalesce(F.nullif("radius", F.lit(0)), F.lit(45)))


def distinct_plots(df: DataFrame) -> DataFrame:
    """The plots worth locating, each once; ``lot_n`` is the leading lot number."""
    e = F.lit("")
    return df.filter("section IS NOT NULL AND section <> ''").select(
        "cem_id", "section", F.coalesce("sub", e).alias("sub"), F.coalesce("block", e).alias("block"), F.coalesce("lot", e).alias("lot")) \
        .distinct().withColumn("lot_n", plots.int_prefix(F.col("lot")))


def locate_plots(plot_rows: DataFrame, plat: DataFrame, anchor: DataFrame, section: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Place of every distinct plot: the first tier with evidence wins, and a drawn lot whose
    own pins lie more than 25 m away is marked disputed."""
    # plots are read by every tier, and each tier is written, so that the driver plans one at a time
    p = written(distinct_plots(plot_rows), "plots")
    entries = written(_keyed_entries(plat), "plat-entries")
    clusters = written(anchor_clusters(anchor), "lot-clusters")
    tiers = union_all([written(tier, "tier") for tier in (
        plat_exact(p, entries), anchor_lot(p, clusters), plat_adjacent(p, entries), anchor_adjacent(p, clusters),
        plat_block(p, plat), anchor_block(p, anchor), section_area(p, section, cemetery),
    )])
    fields = ["tier", "e", "n", "acc", "level", "src", "pins"]
    at = lambda t, c: F.max(F.when(F.col("tier") == t, F.col(c)))
    best = tiers.groupBy(*PLOT).agg(
        F.min_by(F.struct(*fields), "tier").alias("f"),
        at(1, "e").alias("e1"), at(1, "n").alias("n1"), at(2, "e").alias("e2"), at(2, "n").alias("n2"))
    best = best.withColumn("disputed", F.coalesce(
        (F.col("f.tier") == 1) & (geo.dist(F.col("e1"), F.col("n1"), F.col("e2"), F.col("n2")) > 25), F.lit(False)))
    cem = cemetery.select("cem_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    return best.select(*PLOT, "f.*", "disputed").join(cem, "cem_id").withColumns({
        "lat": geo.to_lat(F.col("n"), F.col("clat")), "lng": geo.to_lng(F.col("e"), F.col("clat"), F.col("clng")),
    }).drop("clat", "clng")


def with_location(rows: DataFrame, located: DataFrame, prefix: str = "loc_") -> DataFrame:
    """Joins located plots back to rows that carry plot parts."""
    e = F.lit("")
    keys = {f"_{c}": F.coalesce(c, e) for c in PLOT[1:]}
    loc = located.select(F.col("cem_id").alias("_cem"), *[F.col(c).alias(f"l_{c}") for c in PLOT[1:]],
                         *[F.col(c).alias(prefix + c) for c in ("e", "n", "lat", "lng", "acc", "level", "src", "pins", "disputed")])
    cond = F.col("cem_id") == F.col("_cem")
    df = rows.withColumns(keys)
    for c in PLOT[1:]:
        cond = cond & (F.col(f"_{c}") == F.col(f"l_{c}"))
    return df.join(loc, cond, "left").drop("_cem", *keys, *[f"l_{c}" for c in PLOT[1:]])
