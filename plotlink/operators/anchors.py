"""GPS anchors, their clusters, derived sections and walk-row fits."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.functions import geo, plots
from plotlink.functions.frames import union_all
from plotlink.functions.lineage import written
from plotlink.functions.order import pick_at

LOT = ["cem_id", "section", "sub", "block", "lot_key"]
BLOCK = ["cem_id", "section", "sub", "block"]


def _to_en(df: DataFrame, cemetery: DataFrame) -> DataFrame:
    cem = cemetery.select("cem_id", F.col("lat").alias("_clat"), F.col("lng").alias("_clng"))
    return df.join(cem, "cem_id").withColumns({
        "e": F.round(geo.east(F.col("lng"), F.col("_clat"), F.col("_clng")), 4),
        "n": F.round(geo.north(F.col("lat"), F.col("_clat")), 4),
    }).drop("_clat", "_clng")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "sub": F.coalesce("sub", F.lit("")), "block": F.coalesce("block", F.lit("")),
        "lot_key": plots.lot_key(F.col("lot")),
    })


def gps_anchors(memorial: DataFrame, register_pins: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Pinned memorials with a plot, one per exact coordinate of the cemetery (the first),
    plus field pins saved on register rows. ``register_pins``: register columns, lat, lng."""
    cols = ["ord", "section", "sub", "block", "lot", "lat", "lng"]
    mem = memorial.filter("lat IS NOT NULL AND lng IS NOT NULL AND section IS NOT NULL") \
        .groupBy("cem_id", F.round("lat", 6).alias("_a"), F.round("lng", 6).alias("_b")) \
        .agg(F.min_by(F.struct(*cols), "ord").alias("f")).select("cem_id", "f.*", F.lit("memorial").alias("src"))
    ros = register_pins.filter("section <> ''").select("cem_id", *cols, F.lit("field").alias("src"))
    out = _to_en(_keyed(mem.unionByName(ros)), cemetery)
    return out.select(*LOT, "e", "n", "src", "ord")


def register_anchors(register: DataFrame, linked: DataFrame, memorial: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Register positions carrying the pin of their linked memorial, unless the memorial's own
    plot already has that key. One per key and coordinate."""
    mem = _keyed(memorial.filter("lat IS NOT NULL")).select(
        "cem_id", "mid", "lat", "lng", F.col("section").alias("m_section"), F.col("sub").alias("m_sub"),
        F.col("block").alias("m_block"), F.col("lot_key").alias("m_lot"))
    rows = _keyed(register.filter("section <> ''")).select(*LOT, "key", "ord") \
        .join(linked.select("cem_id", "key", "mid"), ["cem_id", "key"]).join(mem, ["cem_id", "mid"])
    same = F.coalesce((F.col("section") == F.col("m_section")) & (F.col("sub") == F.col("m_sub"))
                      & (F.col("block") == F.col("m_block")) & (F.col("lot_key") == F.col("m_lot")), F.lit(False))
    rows = rows.filter(~same).groupBy(*LOT, F.round("lat", 6).alias("_a"), F.round("lng", 6).alias("_b")).agg(
        F.min_by(F.struct("lat", "lng", "ord"), "ord").alias("f")).select(*LOT, "f.*")
    return _to_en(rows, cemetery).select(*LOT, "e", "n", F.lit("register").alias("src"), "ord")


def anchor_clusters(anchor: DataFrame, keys: list[str] = LOT, trim_m: float = 25) -> DataFrame:
    """Per key: upper-median position, trimmed to ``trim_m`` around it, median again, RMS
    spread and the number of pins kept."""
    med = anchor.groupBy(*keys).agg(
        geo.median_upper("e").alias("_e0"), geo.median_upper("n").alias("_n0"), F.count("*").alias("n_all"))
    near = anchor.select(*keys, "e", "n").join(med, keys).withColumn(
        "_k", geo.dist(F.col("e"), F.col("n"), F.col("_e0"), F.col("_n0")) <= trim_m)
    de, dn = F.expr("e - _e0"), F.expr("n - _n0")
    keep = lambda c: F.when(F.col("_k"), c)
    sums = {"c": F.count(keep(F.lit(1))), "se": F.sum(keep(de)), "sn": F.sum(keep(dn)), "ss": F.sum(keep(de * de + dn * dn)),
            "ac": F.count("*"), "ase": F.sum(de), "asn": F.sum(dn), "ass": F.sum(de * de + dn * dn)}
    g = near.groupBy(*keys, "_e0", "_n0", "n_all").agg(
        geo.median_upper("CASE WHEN _k THEN e END").alias("ke"), geo.median_upper("CASE WHEN _k THEN n END").alias("kn"),
        *[v.alias(f"_{k}") for k, v in sums.items()])
    none = F.col("_c") == 0
    either = lambda a, b: F.when(none, F.col(a)).otherwise(F.col(b))
    g = g.withColumns({
        "e": either("_e0", "ke"), "n": either("_n0", "kn"), "pins": either("_ac", "_c"),
        "_s1": either("_ase", "_se"), "_s2": either("_asn", "_sn"), "_q": either("_ass", "_ss"),
    })
    # sum of squares about the final median, from sums taken about the first one
    ue, un = F.expr("e - _e0"), F.expr("n - _n0")
    ss = F.col("_q") - 2 * (ue * F.col("_s1") + un * F.col("_s2")) + F.col("pins") * (ue * ue + un * un)
    return g.withColumn("spread", F.sqrt(F.greatest(ss, F.lit(0.0)) / F.col("pins"))) \
        .select(*keys, "e", "n", "spread", "pins", "n_all")


def derive_sections(anchor: DataFrame, given: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Section centroids: the given ones, and for cemeteries with none, the median of at
    least three anchors with the 80th-percentile distance (30-160 m) as radius."""
    by = ["cem_id", "section"]
    own = given.select("cem_id").distinct()
    pts = anchor.join(own, "cem_id", "left_anti")
    med = written(pts.groupBy(*by).agg(geo.median_upper("e").alias("ce"), geo.median_upper("n").alias("cn"),
                                       F.count("*").alias("anchors")).filter("anchors >= 3"), "section-medians")
    d = pts.join(med, by).withColumn("d", F.round(geo.dist(F.col("e"), F.col("n"), F.col("ce"), F.col("cn")), 2))
    p80 = pick_at(d, by, "d", F.floor(0.8 * (F.col("n") - 1)), "p80").drop("n")
    cem = cemetery.select("cem_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    derived = med.join(p80, by).join(cem, "cem_id").select(
        *by, F.round(geo.to_lat(F.col("cn"), F.col("clat")), 6).alias("lat"),
        F.round(geo.to_lng(F.col("ce"), F.col("clat"), F.col("clng")), 6).alias("lng"), "anchors",
        geo.half_up(F.least(F.lit(160.0), F.greatest(F.lit(30.0), F.col("p80")))).cast("int").alias("radius"), F.lit(True).alias("derived"))
    fixed = given.select(*by, "lat", "lng", F.lit(None).cast("bigint").alias("anchors"), "radius", F.lit(False).alias("derived"))
    return derived.unionByName(fixed)


def fit_walk_rows(register: DataFrame, linked: DataFrame, memorial: DataFrame, register_pins: DataFrame,
                  plat: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Least-squares line through each register row's pinned positions; every registered
    position within the anchored span (and a short extension) gets a place. One output row
    per placed position, with the cemetery's residual median and quality."""
    row = ["cem_id", "section", "block"]
    pins = union_all([
        linked.join(memorial.filter("lat IS NOT NULL").select("cem_id", "mid", "lat", "lng"), ["cem_id", "mid"])
        .select("cem_id", "key", "lat", "lng", F.lit(1).alias("_p")),
        register_pins.select("cem_id", "key", "lat", "lng", F.lit(0).alias("_p")),
    ]).groupBy("cem_id", "key").agg(F.min_by(F.struct("lat", "lng"), "_p").alias("g")).select("cem_id", "key", "g.*")
    cells = register.filter("section <> '' AND block <> ''").withColumn("pos", plots.int_prefix(F.col("lot"))) \
        .filter("pos IS NOT NULL").select(*row, "pos", "key").join(_to_en(pins, cemetery).select("cem_id", "key", "e", "n"), ["cem_id", "key"], "left") \
        .groupBy(*row, "pos").agg(F.avg("e").alias("e"), F.avg("n").alias("n"))
    cells = written(cells, "walk-cells")  # read three times below, as are the fits
    pts = cells.filter("e IS NOT NULL")
    fit = pts.groupBy(*row).agg(
        F.count("*").alias("n_pts"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
        F.regr_slope("e", "pos").alias("se"), F.regr_intercept("e", "pos").alias("ie"),
        F.regr_slope("n", "pos").alias("sn"), F.regr_intercept("n", "pos").alias("in_"),
    ).filter((F.col("n_pts") >= 2) & F.sqrt(F.expr("se * se + sn * sn")).between(0.5, 5))
    fit = written(fit, "walk-fits")
    res = pts.join(fit, row).withColumn("res", F.round(geo.dist(F.expr("ie + se * pos"), F.expr("in_ + sn * pos"), F.col("e"), F.col("n")), 3))
    # the step gate already fixed the rows, so one aggregate gives each row's median residual
    med = res.groupBy(*row).agg(geo.median_upper("res").alias("row_median"), F.first("n_pts").alias("_n"))
    good = fit.join(med.filter("_n < 3 OR row_median <= 8").drop("_n"), row)
    kept = res.join(good.select(*row), row, "left_semi")
    loo = kept.groupBy("cem_id").agg(geo.median_upper("res").alias("m")).select(
        "cem_id", (geo.half_up(F.col("m") * 10) / 10).alias("loo_median"))
    ext = F.least(F.lit(6), F.greatest(F.lit(2), F.col("hi") - F.col("lo")))
    placed = cells.drop("e", "n").join(good, row).filter(F.col("pos").between(F.col("lo") - ext, F.col("hi") + ext))
    drawn = plat.select("cem_id", "section", "block", F.col("lot").alias("_lot"))
    placed = placed.join(drawn, (placed.cem_id == drawn.cem_id) & (placed.section == drawn.section)
                         & (placed.block == drawn.block) & (placed.pos.cast("string") == drawn._lot), "left_anti")
    return placed.join(loo, "cem_id").select(
        *row, F.col("pos").cast("string").alias("lot"), F.round(F.expr("ie + se * pos"), 2).alias("e"),
        F.round(F.expr("in_ + sn * pos"), 2).alias("n"), "loo_median",
        F.when(F.col("loo_median") <= 4, "fair").otherwise("approx").alias("quality"))


def dynamic_plat(walk_rows: DataFrame) -> DataFrame:
    """Walk-row placements in the form of plat entries; they come after every drawn map."""
    return walk_rows.select(
        "cem_id", F.lit(1000).alias("map_ord"), "section", F.lit("").alias("sub"), F.lit("rows").alias("style"), "quality",
        "loo_median", F.col("lot").cast("bigint").alias("ord"), "block", "lot", "e", "n")


def suggest_section(request: DataFrame, memorial: DataFrame) -> DataFrame:
    """Section holding most of the cemetery's deaths within six years of the request's death
    year: sections with 15 dated burials, at least ten deaths, at least 45 % of them."""
    cnt = memorial.filter("dy <> 0 AND section IS NOT NULL AND section <> '*'").groupBy("cem_id", "section", "dy").agg(F.count("*").alias("c"), F.min("ord").alias("first"))
    size = cnt.groupBy("cem_id", "section").agg(F.sum("c").alias("size"), F.min("first").alias("first")).filter("size >= 15")
    cnt = cnt.drop("first").join(size, ["cem_id", "section"]).select("cem_id", "section", "first", "c", F.explode(F.expr("sequence(dy - 6, dy + 6)")).alias("dy"))
    near = cnt.groupBy("cem_id", "dy", "section", "first").agg(F.sum("c").alias("n_near"))
    best = near.groupBy("cem_id", "dy").agg(
        F.sum("n_near").alias("total"), F.max("n_near").alias("top"),
        F.min_by("section", F.struct(-F.col("n_near"), "first")).alias("suggested"))
    best = best.filter("total >= 10 AND top / total >= 0.45")
    return request.filter("dy <> 0").select("cem_id", "ord", "mid", "dy").join(best, ["cem_id", "dy"]).select(
        "cem_id", "ord", "mid", "dy", "suggested", geo.half_up(F.expr("100 * top / total")).cast("int").alias("share"))
