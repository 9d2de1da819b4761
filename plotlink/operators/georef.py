"""Geo-referencing many plat maps at once: pairs, affine and similarity fits, consensus
searches, label bands and clusters. Every fit is a set of sums per map, so no map is ever
gathered in one place."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import geo, plots
from plotlink.functions.frames import once
from plotlink.functions.lineage import checkpointed, written
from plotlink.functions.order import pick_at, pick_global, picks_at

T6 = ["a", "b", "c", "d", "f", "g"]


def pin_weights(memorial: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Pinned plots with numeric lots, in local metres, weighted down by 1/sqrt(n) where n of
    them share one coordinate; pins nearer than 5 m or farther than 500 m do not count."""
    cem = cemetery.select("cem_id", F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    df = memorial.filter("lat IS NOT NULL AND section IS NOT NULL").join(cem, "cem_id").withColumns({
        "e": F.round(geo.east(F.col("lng"), F.col("_a"), F.col("_b")), 4), "n": F.round(geo.north(F.col("lat"), F.col("_a")), 4),
        "_la": F.round("lat", 6), "_ln": F.round("lng", 6), "lot_n": plots.int_prefix(F.col("lot"))})
    df = df.filter(geo.dist(F.col("e"), F.col("n"), F.lit(0.0), F.lit(0.0)).between(5, 500))
    same = df.groupBy("cem_id", "_la", "_ln").agg(F.count("*").alias("_c"))
    return df.join(same, ["cem_id", "_la", "_ln"]).filter("lot_n IS NOT NULL").select(
        "cem_id", "section", "sub", "block", "lot_n", "e", "n", (1 / F.sqrt("_c")).alias("w"), "ord")


def map_anchor_pairs(label: DataFrame, pins: DataFrame, group: list[str] = ("map_id",)) -> DataFrame:
    """Pins joined to the one label their lot has on a map (lots drawn twice say nothing).
    ``label``: group columns, cem_id, section, style, block, lot, x, y."""
    return _met(label, pins, group, ["e", "n", "w", "ord"])


def _met(label: DataFrame, pins: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    key = F.when(F.col("style") == "lots", "").otherwise(F.col("block"))
    lab = label.withColumns({"_b": key, "lot_n": plots.int_prefix(F.col("lot"))}).filter("lot_n IS NOT NULL")
    one = lab.groupBy(*group, "cem_id", "section", "style", "_b", "lot_n").agg(F.count("*").alias("_c"), F.min("x").alias("x"), F.min("y").alias("y")).filter("_c = 1")
    p = pins.withColumn("_blk", F.coalesce("block", F.lit("")))
    # a lots-style map ignores blocks, the others need them equal: two equi joins, one result
    by_lot = one.filter("style = 'lots'").join(p, ["cem_id", "section", "lot_n"])
    by_block = one.filter("style <> 'lots'").withColumnRenamed("_b", "_blk").join(p, ["cem_id", "section", "lot_n", "_blk"])
    cols = [*group, "x", "y", *cols]
    return by_lot.select(*cols).unionByName(by_block.select(*cols))


_SUMS = {"w": "w", "x": "w * x", "y": "w * y", "xx": "w * x * x", "xy": "w * x * y", "yy": "w * y * y", "e": "w * e", "n": "w * n",
         "xe": "w * x * e", "ye": "w * y * e", "xn": "w * x * n", "yn": "w * y * n"}


def _solve(s) -> dict[str, Column]:
    """Affine coefficients from weighted sums (centred, so the 2x2 system stays well posed)."""
    mx, my, me, mn = (s(k) / s("w") for k in ("x", "y", "e", "n"))
    sxx, sxy, syy = s("xx") - s("x") * mx, s("xy") - s("x") * my, s("yy") - s("y") * my
    det = sxx * syy - sxy * sxy
    # points on one line fix no affine; the test is relative, since exact zeros do not occur
    ok = F.abs(det) > 1e-9 * s("xx") * s("yy")
    out = {}
    for (k1, k2, k0), t, mt in ((("a", "b", "c"), "e", me), (("d", "f", "g"), "n", mn)):
        sx, sy = s("x" + t) - s("x") * mt, s("y" + t) - s("y") * mt
        out[k1] = F.when(ok, F.try_divide(sx * syy - sy * sxy, det))
        out[k2] = F.when(ok, F.try_divide(sy * sxx - sx * sxy, det))
        out[k0] = mt - out[k1] * mx - out[k2] * my
    return out


def fit_affine(pairs: DataFrame, group: list[str] = ("map_id",), least: int = 4) -> DataFrame:
    """Weighted least-squares affine x, y -> e, n per group of at least four pairs."""
    g = pairs.groupBy(*group).agg(F.count("*").alias("n_pairs"), *[F.sum(F.expr(v)).alias(f"_s{k}") for k, v in _SUMS.items()])
    return _fitted(g, group, least)


def _fitted(sums: DataFrame, group: list[str], least: int) -> DataFrame:
    g = sums.filter(F.col("n_pairs") >= least)
    return once(g, _solve(lambda k: F.col(f"_s{k}"))).filter("a IS NOT NULL").select(*group, "n_pairs", *T6)


def fit_anchors(label: DataFrame, pins: DataFrame, group: list[str] = ("map_id",), least: int = 4) -> DataFrame:
    """``fit_affine`` of ``map_anchor_pairs``, without laying the pairs out: where many maps draw a lot and many pins lie
    in it, these are their product. All pins of a lot meet a label at one place, so their sums are enough."""
    lot = pins.groupBy("cem_id", "section", "block", "lot_n").agg(
        F.count("*").alias("_n"), F.sum("w").alias("w"), F.sum(F.expr("w * e")).alias("we"), F.sum(F.expr("w * n")).alias("wn"))
    met = _met(label, lot, group, ["_n", "w", "we", "wn"])
    of_pins = {k: v.replace("w * e", "we").replace("w * n", "wn").replace("w * x * e", "x * we").replace("w * y * e", "y * we")
               .replace("w * x * n", "x * wn").replace("w * y * n", "y * wn") for k, v in _SUMS.items()}
    g = met.groupBy(*group).agg(F.sum("_n").alias("n_pairs"), *[F.sum(F.expr(v)).alias(f"_s{k}") for k, v in of_pins.items()])
    return _fitted(g, group, least)


def residual(t: str = "") -> Column:
    c = lambda k: F.col(t + k)
    return F.sqrt(F.pow(c("a") * F.col("x") + c("b") * F.col("y") + c("c") - F.col("e"), 2)
                  + F.pow(c("d") * F.col("x") + c("f") * F.col("y") + c("g") - F.col("n"), 2))


def leave_one_out(pairs: DataFrame, group: list[str] = ("map_id",)) -> DataFrame:
    """Error of each pair under the fit of all the others: the group's sums minus the pair's
    own terms give that fit without going over the group again."""
    g = pairs.groupBy(*group).agg(F.count("*").alias("_n"), *[F.sum(F.expr(v)).alias(f"_s{k}") for k, v in _SUMS.items()]).filter("_n >= 5")
    j = pairs.join(g, list(group))
    j = once(j, {f"_r{k}": F.col(f"_s{k}") - F.expr(v) for k, v in _SUMS.items()})
    j = once(j, _solve(lambda k: F.col(f"_r{k}"))).filter("a IS NOT NULL").withColumn("err", F.round(residual(), 4))
    share = {"median": 0.5, "p75": 0.75, "p90": 0.9}
    picked = picks_at(j, list(group), "err", {name: F.floor(q * (F.col("n") - 1)) for name, q in share.items()})
    return picked.select(*group, *[F.round(name, 1).alias(name) for name in share], F.col("n").alias("n_loo"))


TRIPLES = 4000
#: One multiplicative generator for each corner of a drawn triple.
DRAWS, PRIME = (48271, 69621, 39373), 2147483647
#: Parts into which the hypotheses of a group are dealt when they meet its pairs.
PARTS = 8
#: The same for the pairs of a page's seeds or a sheet's cells.
SEED_PARTS = 32


def _drawn(corner: int, seed: int) -> Column:
    """Index 1..n of a corner of triple ``_h``: integer arithmetic that any engine repeats."""
    return ((F.col("_h") * DRAWS[corner] + (corner + 1) * seed) % PRIME * 16807 % PRIME % F.col("_n") + 1)


def _triples(items: DataFrame, g: list[str], cols: list[str], exhaustive: int, draws: int, seed: int) -> DataFrame:
    """Triples of the numbered items (``_i``, group size ``_n``) of each group: all of them up to
    ``exhaustive`` items, else ``draws`` triples drawn from all items."""
    side = lambda s: items.select(*g, *[F.col(c).alias(f"{c}{s}") for c in (*cols, "_i")])
    few = items.filter(F.col("_n") <= exhaustive).select(*g, *[F.col(c).alias(f"{c}0") for c in (*cols, "_i")])
    every = few.join(side(1), g).filter("_i0 < _i1").join(side(2), g).filter("_i1 < _i2")
    number = items.filter((F.col("_n") > exhaustive) & (F.col("_i") == 1)).select(*g, "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))).alias("_h"))
    drawn = number.select(*g, *[_drawn(j, seed).alias(f"_i{j}") for j in range(3)]).filter("_i0 <> _i1 AND _i1 <> _i2 AND _i0 <> _i2").distinct()
    for j in range(3):
        drawn = drawn.join(side(j), [*g, f"_i{j}"])
    return every.unionByName(drawn.select(every.columns))


def _places(pairs: DataFrame, g: list[str], vote: str | None = None) -> DataFrame:
    """The pairs, those of one label and one place as one row with their number: many pins at the same stone are tested once."""
    return pairs.groupBy(*g, "x", "y", "e", "n", *([vote] if vote else [])).agg(F.count("*").alias("_same"))


def ransac_affine(pairs: DataFrame, group: list[str] = ("map_id",), inlier_m: float = 13, exhaustive: int = 26, seed: int = 12345, area: float = 400,
                  vote: str | None = None, least: int = 4, scales: tuple[float, float] | None = None, draws: int = TRIPLES) -> DataFrame:
    """Best affine by consensus. Hypotheses are exact fits of pair triples: all of them for
    groups of up to ``exhaustive`` pairs, else triples drawn from all pairs, so their number is
    bounded whatever a group's size. The triple with most inliers (at least ``least``) is refitted on
    them, widened to every pair it now explains, and refitted once more. ``area``: least double
    area of a triple; ``vote``: the column whose distinct values are counted, else every pair
    counts; ``scales``: what both axes of a hypothesis may stretch."""
    g = list(group)
    size = pairs.groupBy(*g).agg(F.count("*").alias("_n"))
    p = pairs.join(size, g)
    # numbered pairs are read seven times, the best triples twice: each is written once
    p = written(p.withColumn("_i", F.row_number().over(Window.partitionBy(*g).orderBy("ord", "x", "y"))), "numbered-pairs")
    tri = _triples(p, g, ["x", "y", "e", "n"], exhaustive, draws, seed)
    det = F.expr("(x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)")
    tri = tri.withColumn("_det", det).filter(F.abs("_det") >= area)
    lin = lambda t: (F.expr(f"({t}1 - {t}0) * (y2 - y0) - ({t}2 - {t}0) * (y1 - y0)") / F.col("_det"),
                     F.expr(f"({t}2 - {t}0) * (x1 - x0) - ({t}1 - {t}0) * (x2 - x0)") / F.col("_det"))
    (a, b), (d, f) = lin("e"), lin("n")
    tri = once(tri, {"a": a, "b": b, "d": d, "f": f})
    tri = tri.withColumns({"c": F.expr("e0 - a * x0 - b * y0"), "g": F.expr("n0 - d * x0 - f * y0")})
    if scales:
        tri = tri.filter(F.expr("sqrt(a * a + d * d)").between(*scales) & F.expr("sqrt(b * b + f * f)").between(*scales))
    hyp = tri.select(*g, "_i0", "_i1", "_i2", *T6, F.pmod(F.xxhash64("_i0", "_i1", "_i2"), F.lit(PARTS)).cast("int").alias("_part"))
    dealt = _places(pairs, g, vote).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    hit = hyp.join(dealt, [*g, "_part"]).filter(residual() <= inlier_m)
    cnt = hit.groupBy(*g, "_i0", "_i1", "_i2", *T6).agg((F.count_distinct(vote) if vote else F.sum("_same")).alias("_c")).filter(F.col("_c") >= least)
    best = cnt.groupBy(*g).agg(F.min_by(F.struct(*T6), F.struct(-F.col("_c"), "_i0", "_i1", "_i2")).alias("t")).select(*g, "t.*")
    best = written(best, "best-triples")
    within = lambda t: pairs.join(t.select(*g, *T6), g).filter(residual() <= inlier_m).drop(*T6)
    first = fit_affine(within(best), g)
    again = fit_affine(within(first), g)
    keep = [*g, F.col("n_pairs").alias("used"), *T6]
    return again.select(*keep).unionByName(first.join(again.select(*g), g, "left_anti").select(*keep))


def explained_pairs(pairs: DataFrame, fit: DataFrame, group: list[str] = ("map_id",), inlier_m: float = 13) -> DataFrame:
    return pairs.join(fit.select(*group, *T6), list(group)).filter(residual() <= inlier_m).drop(*T6)


# ---------------------------------------------------------------- labels on a page

def lot_labels(label: DataFrame) -> DataFrame:
    """Number labels in their map's dominant font size. ``label``: map_id, s, fh, x, y."""
    num = label.filter(F.col("s").rlike(r"^\d{1,4}$"))
    size = num.groupBy("map_id", "fh").agg(F.count("*").alias("_c")) \
        .groupBy("map_id").agg(F.min_by("fh", F.struct(-F.col("_c"), "fh")).alias("lot_fh"))
    return num.join(size, "map_id").filter(F.abs(F.col("fh") - F.col("lot_fh")) < 0.75)


def block_labels(label: DataFrame) -> DataFrame:
    return label.filter(F.col("s").rlike("^[A-Z]$") & (F.col("fh") >= 9) & (F.col("fh") < 11.8) & ~((F.col("x") < 45) & (F.col("fh") >= 11)))


def row_bands(label: DataFrame, gap: float = 12, least: int = 5) -> DataFrame:
    """Labels of row-style maps in bands of equal height: a vertical gap starts a new band,
    thin bands are dropped. Gaps are searched among distinct heights only."""
    lots = lot_labels(label)
    ys = lots.groupBy("map_id", "y").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("map_id").orderBy("y")
    ys = ys.withColumn("_new", F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)).withColumn("_band", F.sum("_new").over(w))
    big = ys.groupBy("map_id", "_band").agg(F.sum("_c").alias("_c")).filter(F.col("_c") >= least)
    big = big.withColumn("row_idx", F.row_number().over(Window.partitionBy("map_id").orderBy("_band")) - 1)
    return lots.join(ys.select("map_id", "y", "_band"), ["map_id", "y"]).join(big.select("map_id", "_band", "row_idx"), ["map_id", "_band"]) \
        .select("map_id", "row_idx", F.col("s").alias("lot"), "x", "y")


def _bands(label: DataFrame) -> DataFrame:
    """Block labels of a map as one short array (letters on a printed page), with band height."""
    b = block_labels(label).groupBy("map_id").agg(F.array_sort(F.collect_set(F.struct("y", F.col("s").alias("block")))).alias("bands"))
    n = F.size("bands")
    span = (F.element_at("bands", -1)["y"] - F.element_at("bands", 1)["y"]) / (n - 1)
    return b.withColumn("band_h", F.when(n > 1, span).otherwise(60.0))


def _assign(lots: DataFrame, delta: Column) -> DataFrame:
    off = lambda v: F.abs(F.col("y") - (v.y + delta))
    near = F.array_min(F.transform("bands", lambda v: F.struct(off(v).alias("d"), v.y.alias("y"), v.block.alias("block"))))
    df = lots.withColumn("_n", near).filter(F.col("_n.d") <= F.col("band_h") * 0.75)
    return df.withColumn("block", F.col("_n.block")).drop("_n", "bands")


def label_bands(label: DataFrame, delta: float = 0.0) -> DataFrame:
    """Lot labels with the block of the nearest band, ``delta`` below its letter."""
    lots = lot_labels(label).join(_bands(label), "map_id")
    return _assign(lots, F.lit(delta)).select("map_id", "block", F.col("s").alias("lot"), "x", "y")


def _tried(hyp: DataFrame, pins: DataFrame, g: list[str], least: int) -> DataFrame:
    """g, n_pairs and loo (leave-one-out median) of every hypothesis that has at least ``least`` pairs and a fit. One
    hypothesis is one group of the very same fitting jobs."""
    pairs = written(map_anchor_pairs(hyp, pins, g), "hypothesis-pairs")
    size = pairs.groupBy(*g).agg(F.count("*").alias("n_pairs")).filter(F.col("n_pairs") >= least)
    pairs = pairs.join(size.select(*g), g)
    fit = written(ransac_affine(pairs, g), "hypothesis-fits")
    loo = leave_one_out(explained_pairs(pairs, fit, g), g).select(*g, F.col("median").alias("loo"))
    return size.join(fit.select(*g), g).join(loo, g, "left")


def band_offset_search(label: DataFrame, maps: DataFrame, pins: DataFrame) -> DataFrame:
    """Offset between a block's letter and its band, by leave-one-out error of the fit it
    leads to; within 20 % of the best error, more matched pairs win. A map on which no offset can be fitted takes
    the middle of its bands, with no pairs. ``maps``: map_id, cem_id, section, style."""
    bands = _bands(label)
    lots = lot_labels(label).join(bands, "map_id").join(maps, "map_id")
    top = geo.half_up(F.col("band_h") * 0.6).cast("int")
    hyp = lots.withColumn("delta", F.explode(F.sequence(-top, top, F.lit(2))))
    hyp = _assign(hyp, F.col("delta")).select("map_id", "delta", "cem_id", "section", "style", "block", F.col("s").alias("lot"), "x", "y")
    tried = _tried(hyp, pins, ["map_id", "delta"], 5).filter("loo IS NOT NULL")
    tried = tried.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("delta", "loo", "n_pairs"))).alias("tries"))
    better = lambda s, t: (s.n_pairs == 0) | (t.loo < s.loo * 0.8) | ((t.loo < s.loo * 1.2) & (t.n_pairs > s.n_pairs))
    none = F.struct(F.lit(0).alias("delta"), F.lit(1e12).alias("loo"), F.lit(0).cast("bigint").alias("n_pairs"))
    pick = F.aggregate("tries", none, lambda s, t: F.when(better(s, t), t).otherwise(s))
    found = tried.select("map_id", F.size("tries").alias("n_tried"), pick.alias("p")).select("map_id", "n_tried", F.col("p.delta").cast("double").alias("delta"), "p.loo", "p.n_pairs")
    middle = bands.join(maps.select("map_id"), "map_id", "left_semi").join(found.select("map_id"), "map_id", "left_anti")
    return found.unionByName(middle.select("map_id", F.lit(0).alias("n_tried"), (F.col("band_h") / 2).alias("delta"), F.lit(None).cast("double").alias("loo"), F.lit(0).cast("bigint").alias("n_pairs")))


def row_number_search(rows: DataFrame, maps: DataFrame, pins: DataFrame, offsets: int = 3) -> DataFrame:
    """How the rows of a row-style map are numbered: from the top or from the bottom, and from which number on. Each
    of the 2 x ``offsets`` ways names every label's row; the way whose fit has the least leave-one-out error
    wins (999 where four pairs allow none), of equal ones the first. Without any fit rows count from the top.
    ``rows``: map_id, row_idx, lot, x, y of ``row_bands``; ``maps``: map_id, cem_id, section."""
    count = rows.groupBy("map_id").agg((F.max("row_idx") + 1).alias("n_rows"))
    ways = F.array(*[F.struct(F.lit(w).alias("way"), F.lit(d).alias("direction"), F.lit(o).alias("first")) for w, (d, o) in enumerate((d, o) for d in (1, -1) for o in range(offsets))])
    hyp = rows.join(count, "map_id").join(maps.select("map_id", "cem_id", "section"), "map_id").withColumn("_w", F.explode(ways)).select("*", "_w.*")
    number = F.when(F.col("direction") == 1, F.col("row_idx") + 1 + F.col("first")).otherwise(F.col("n_rows") - F.col("row_idx") + F.col("first"))
    hyp = hyp.select("map_id", "way", "direction", "first", "cem_id", "section", F.lit("rows").alias("style"), number.cast("string").alias("block"), "lot", "x", "y")
    tried = _tried(hyp, pins, ["map_id", "way", "direction", "first"], 4).withColumn("loo", F.when(F.col("n_pairs") >= 5, F.col("loo")).otherwise(999.0)).filter("loo IS NOT NULL")
    best = tried.groupBy("map_id").agg(F.min_by(F.struct("direction", "first", "loo", "n_pairs"), F.struct("loo", "way")).alias("b"), F.count("*").alias("n_tried"))
    return count.join(best, "map_id", "left").select("map_id", "n_rows", F.coalesce("n_tried", F.lit(0)).alias("n_tried"), F.coalesce("b.direction", F.lit(1)).alias("direction"),
                                                     F.coalesce("b.first", F.lit(0)).alias("first"), F.col("b.loo").alias("loo"), F.coalesce("b.n_pairs", F.lit(0)).alias("n_pairs"))


# ---------------------------------------------------------------- trust and fallback

def fit_trust_fallback(pairs: DataFrame, fit: DataFrame, loo: DataFrame, label: DataFrame | None = None, centroid: DataFrame | None = None) -> DataFrame:
    """Keeps an affine that is well supported, or consistent with the rotation and scale the
    trusted maps agree on; other maps get that rotation and scale with the translation most
    of their pairs agree on. Where a map's section has a known centre, the mean of its labels standing there
    is one more such pair, so maps without any pair are placed as well. Neighbours within 15 m are counted by
    15 m cells first. ``label``: map_id, x, y; ``centroid``: map_id, e, n.

    Gives map_id, a..g, quality (good, fair, approx, rough), and of maps with three pairs the median and the 90th
    percentile of what is left between all of them and their labels."""
    inl = explained_pairs(pairs, fit)
    spread = inl.groupBy("map_id").agg(
        F.count_distinct(F.round("e", 1), F.round("n", 1)).alias("coords"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("spread"))
    t = fit.join(spread, "map_id").join(loo.select("map_id", F.col("median").alias("loo")), "map_id")
    t = written(t.withColumns({"rot": F.round(F.degrees(F.atan2("d", "a")), 6), "sc": F.round(F.sqrt(F.expr("a * a + d * d")), 6),
                               "strong": (F.col("coords") >= 6) & (F.col("spread") >= 90)}), "trust")
    trusted, middle = t.filter("loo <= 12 AND strong"), F.floor(F.col("n") / 2)
    one = lambda name, width, default: pick_global(trusted, name, width, middle, f"c_{name}").select(F.coalesce(f"c_{name}", F.lit(default)).alias(f"c_{name}"), F.lit(1).alias("_one"))
    # the consensus is one row, so it can be broadcast; the constant key lets every map see it
    cons = written(one("rot", 0.5, 0.0).join(one("sc", 0.01, 0.35), "_one"), "consensus")
    t = t.withColumn("_one", F.lit(1)).join(F.broadcast(cons), "_one").drop("_one")
    dev = F.abs(F.pmod(F.col("rot") - F.col("c_rot") + 540, F.lit(360.0)) - 180)
    consistent = (dev <= 7) & (F.col("sc") / F.col("c_sc")).between(0.8, 1.25)
    ok = (F.col("loo") <= 20) & (F.col("strong") | (consistent & (F.col("coords") >= 4)))
    good = t.filter(ok).select("map_id", *T6, F.when((F.col("loo") <= 8) & F.col("strong"), "good").otherwise("fair").alias("quality"))
    signal = pairs.select("map_id", "ord", "x", "y", "e", "n")
    if label is not None and centroid is not None:
        middle_of = label.groupBy("map_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        signal = signal.unionByName(middle_of.join(centroid, "map_id").select("map_id", F.lit((1 << 62)).alias("ord"), "x", "y", "e", "n"))
    rest = signal.join(good.select("map_id"), "map_id", "left_anti").withColumn("_one", F.lit(1)).join(F.broadcast(cons), "_one")
    ca, cd = F.col("c_sc") * F.cos(F.radians("c_rot")), F.col("c_sc") * F.sin(F.radians("c_rot"))
    off = rest.select("map_id", "ord", ca.alias("ca"), cd.alias("cd"), F.round(F.col("e") - (ca * F.col("x") - cd * F.col("y")), 4).alias("tx"),
                      F.round(F.col("n") - (cd * F.col("x") + ca * F.col("y")), 4).alias("ty"))
    at = off.groupBy("map_id", "ca", "cd", "tx", "ty").agg(F.count("*").alias("c"), F.min("ord").alias("ord"))
    cell = lambda c: F.floor(F.col(c) / 15)
    at = at.withColumns({"_cx": cell("tx"), "_cy": cell("ty")})
    near = at.withColumn("_k", _around()).select("map_id", (F.col("_cx") + F.col("_k.i")).alias("_cx"), (F.col("_cy") + F.col("_k.j")).alias("_cy"),
                                                 F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("c").alias("uc"))
    j = at.join(near, ["map_id", "_cx", "_cy"]).filter(geo.dist(F.col("tx"), F.col("ty"), F.col("ux"), F.col("uy")) <= 15)
    dens = j.groupBy("map_id", "ca", "cd", "tx", "ty", "ord").agg(F.sum("uc").alias("cnt"), (F.sum(F.expr("ux * uc")) / F.sum("uc")).alias("gx"), (F.sum(F.expr("uy * uc")) / F.sum("uc")).alias("gy"))
    best = dens.groupBy("map_id").agg(F.min_by(F.struct("ca", "cd", "gx", "gy", "cnt"), F.struct(-F.col("cnt"), "ord")).alias("b")).select("map_id", "b.*")
    sim = best.select("map_id", F.col("ca").alias("a"), (-F.col("cd")).alias("b"), F.col("gx").alias("c"), F.col("cd").alias("d"), F.col("ca").alias("f"), F.col("gy").alias("g"),
                      F.when(F.col("cnt") >= 3, "approx").otherwise("rough").alias("quality"))
    final = written(good.unionByName(sim), "placed-maps")
    left = pairs.select("map_id", "x", "y", "e", "n").join(final, "map_id").withColumn("err", F.round(residual(), 4))
    stat = lambda q, name: pick_at(left, ["map_id"], "err", q, name).filter("n >= 3").select("map_id", F.round(name, 1).alias(name))
    return final.join(stat(F.floor(F.col("n") / 2), "acc_median"), "map_id", "left").join(stat(F.floor(0.9 * (F.col("n") - 1)), "acc_p90"), "map_id", "left")


# ---------------------------------------------------------------- poses by vote

def _around() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def dealt_pairs(items: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Every pair of a group's numbered items (``_i``), once: the first is dealt to a part, the second sent to all."""
    side = lambda df, s: df.select(*group, "_part", *[F.col(c).alias(f"{c}{s}") for c in ("_i", *cols)])
    first = side(items.withColumn("_part", F.pmod("_i", F.lit(SEED_PARTS))), 0)
    every = side(items.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SEED_PARTS - 1)))), 1)
    return first.join(every, [*group, "_part"]).filter("_i0 < _i1")


def peaks(votes: DataFrame, group: list[str], p: str, q: str, width: Column, top: int) -> DataFrame:
    """The ``top`` places of each group where most votes (p, q) fall, as the mean of a square cell of ``width`` and
    its eight neighbours. Votes are counted by cell before anything else, so a peak of very many costs no more
    than another."""
    cell = lambda c: F.floor(F.round(F.col(c) / width, 6) + 0.5)
    own = votes.withColumns({"_cx": cell(p), "_cy": cell(q)}).groupBy(*group, "_cx", "_cy").agg(F.count("*").alias("_c"), F.sum(p).alias("_p"), F.sum(q).alias("_q"))
    near = own.withColumn("_k", _around()).groupBy(*group, (F.col("_cx") + F.col("_k.i")).alias("_cx"), (F.col("_cy") + F.col("_k.j")).alias("_cy")).agg(
        *[F.sum(c).alias(c) for c in ("_c", "_p", "_q")])
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_c"), "_cx", "_cy"))
    return near.withColumn("peak", best).filter(F.col("peak") <= top).select(
        *group, "peak", F.col("_c").alias("votes"), F.round(F.col("_p") / F.col("_c"), 6).alias(p), F.round(F.col("_q") / F.col("_c"), 6).alias(q))


# ---------------------------------------------------------------- clusters of labels

def connected(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Component (smallest node id) of every node: neighbours' minimum plus pointer jumping,
    so the rounds grow with the logarithm of a component's diameter. ``nodes``: by, id;
    ``edges``: by, a, b in both directions."""
    comp = checkpointed(nodes.select(by, "id", F.col("id").alias("comp")))
    while True:
        near = edges.join(comp.select(by, F.col("id").alias("b"), F.col("comp").alias("c")), [by, "b"]).groupBy(by, "a").agg(F.min("c").alias("c"))
        step = comp.join(near.withColumnRenamed("a", "id"), [by, "id"], "left").select(by, "id", "comp", F.least("comp", "c").alias("nc"))
        # hook the old root as well, then let everyone follow their root
        hook = step.withColumnRenamed("nc", "_nc").groupBy(by, F.col("comp").alias("nc")).agg(F.min(F.col("_nc")).alias("rc"))
        step = checkpointed(step.join(hook, [by, "nc"], "left").select(by, "id", "comp", F.least("nc", "rc").alias("nc")))
        if step.filter("nc <> comp").isEmpty():
            return comp
        comp = step.select(by, "id", F.col("nc").alias("comp"))


def cluster_labels(label: DataFrame, radius: float = 10, min_size: int = 5) -> DataFrame:
    """Groups of number labels closer than ``radius`` to one another, with centre and maximum.

    Labels in one square of side radius/sqrt(2) always belong together, so squares are the
    nodes; only distinct label spots of nearby squares are compared."""
    lab = label.filter(F.col("s").rlike(r"^\d{1,4}(\.5)?$")).withColumn("num", plots.int_prefix(F.col("s")))
    side = radius / math.sqrt(2) * 0.999999
    lab = lab.withColumns({"_cx": F.floor(F.col("x") / side), "_cy": F.floor(F.col("y") / side)})
    node = lambda x, y: (x + 1000000) * 4000000 + (y + 1000000)
    lab = lab.withColumn("sq", node(F.col("_cx"), F.col("_cy")))
    spots = lab.select("map_id", "sq", "_cx", "_cy", "x", "y").distinct()
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)])
    other = spots.withColumn("_k", F.explode(shifts)).select(
        "map_id", F.col("sq").alias("b"), (F.col("_cx") + F.col("_k.i")).alias("_cx"), (F.col("_cy") + F.col("_k.j")).alias("_cy"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    edges = spots.join(other, ["map_id", "_cx", "_cy"]).filter(geo.dist(F.col("x"), F.col("y"), F.col("ox"), F.col("oy")) < radius) \
        .select("map_id", F.col("sq").alias("a"), "b").distinct()
    comp = connected(spots.select("map_id", F.col("sq").alias("id")).distinct(), checkpointed(edges), "map_id")
    named = lab.join(comp.select("map_id", F.col("id").alias("sq"), F.col("comp").alias("cluster")), ["map_id", "sq"]).drop("_cx", "_cy", "sq")
    size = named.groupBy("map_id", "cluster").agg(F.count("*").alias("size"), F.max("num").alias("max_num"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).filter(F.col("size") >= min_size)
    return named.join(size, ["map_id", "cluster"]).select("map_id", "cluster", "s", "num", "x", "y", "size", "max_num", "cx", "cy")


def cluster_compat(clusters: DataFrame, domain: DataFrame) -> DataFrame:
    """Share of each cluster's labels whose number exists in a block. ``domain``: map_id,
    block, num (distinct)."""
    cnt = clusters.groupBy("map_id", "cluster", "size", "num").agg(F.count("*").alias("_c"))
    return cnt.join(domain, ["map_id", "num"]).groupBy("map_id", "cluster", "block").agg((F.sum("_c") / F.first("size")).alias("share"))


def _pin_distance(clusters: DataFrame, compat: DataFrame, pins: DataFrame, t: DataFrame, far: float) -> DataFrame:
    """map_id, cluster, block, share, mdist: the upper median over a cluster's labels of the way to the nearest pin of
    a block; farther than ``far`` is simply too far."""
    cell = lambda c: F.floor(F.col(c) / far)
    spot = clusters.select("map_id", "cluster", "x", "y").join(t, "map_id").withColumns({
        "pe": F.expr("a * x + b * y + c"), "pn": F.expr("d * x + f * y + g")}).select("map_id", "cluster", "pe", "pn") \
        .groupBy("map_id", "cluster", "pe", "pn").agg(F.count("*").alias("k"))
    near = pins.select("map_id", "block", F.round("e", 2).alias("qe"), F.round("n", 2).alias("qn")).distinct() \
        .withColumn("_k", _around()).withColumns({"_cx": cell("qe") + F.col("_k.i"), "_cy": cell("qn") + F.col("_k.j")}).drop("_k")
    fits = compat.filter("share >= 0.7").join(spot, ["map_id", "cluster"]).withColumns({"_cx": cell("pe"), "_cy": cell("pn")})
    d = fits.join(near, ["map_id", "block", "_cx", "_cy"], "left").groupBy("map_id", "cluster", "block", "share", "pe", "pn", "k").agg(
        F.coalesce(F.min(geo.dist(F.col("pe"), F.col("pn"), F.col("qe"), F.col("qn"))), F.lit(1e9)).alias("d"))
    d = d.withColumn("d", F.round("d", 2)).withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    return d.groupBy("map_id", "cluster", "block", "share").agg(geo.median_upper("d").alias("mdist"))


def _by_pins(md: DataFrame, sigma: float, far: float, veto: float) -> DataFrame:
    """map_id, cluster, block: share of known numbers times closeness to the block's pins; a runner-up nearly as good
    refuses the guess."""
    sc = md.filter(F.col("mdist") <= far).withColumn("score", F.col("share") * F.exp(-(F.col("mdist") * F.col("mdist")) / (2 * sigma * sigma)))
    w = Window.partitionBy("map_id", "cluster").orderBy(F.desc("score"), "block")
    top = sc.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy("map_id", "cluster").agg(
        F.max(F.when(F.col("_r") == 1, F.struct("score", "block", "mdist"))).alias("b"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("s2"))
    return top.filter((F.col("s2").isNull() | (F.col("s2") <= F.col("b.score") * veto)) & (F.col("b.mdist") <= 40)).select("map_id", "cluster", F.col("b.block").alias("block"))


def lot_pairs(clusters: DataFrame, domain: DataFrame, pins: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pins with the one label that has their lot's number in the clusters of their block. ``pins``: with lot_n."""
    label = clusters.join(assigned, ["map_id", "cluster"]).join(domain, ["map_id", "block", "num"])
    one = label.groupBy("map_id", "block", "num").agg(F.count("*").alias("_c"), F.min("x").alias("x"), F.min("y").alias("y")).filter("_c = 1")
    return pins.filter("lot_n IS NOT NULL").join(one, (pins.map_id == one.map_id) & (pins.block == one.block) & (pins.lot_n == one.num)).select(pins.map_id, "x", "y", "e", "n")


def refit_by_lots(pairs: DataFrame, seeds: DataFrame, transform: DataFrame, weight: int = 3, least: int = 6, turn: float = 12) -> DataFrame:
    """Transforms of pages with at least ``least`` lot pairs, fitted anew to these, ``weight`` times, and the seeds; a page
    that would turn by more than ``turn`` degrees keeps its own, like the others."""
    many = pairs.groupBy("map_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("map_id")
    heavy = pairs.join(many, "map_id").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(weight)))).drop("_k")
    new = fit_similarity(heavy.unionByName(seeds.select(*heavy.columns).join(many, "map_id"))).filter(F.abs(F.degrees(F.atan2("d", "a"))) <= turn)
    return new.select("map_id", *T6).unionByName(transform.select("map_id", *T6).join(new.select("map_id"), "map_id", "left_anti"))


def assign_clusters(clusters: DataFrame, domain: DataFrame, pins: DataFrame, transform: DataFrame, sigma: float = 22, far: float = 55, veto: float = 0.55,
                    seeds: DataFrame | None = None) -> DataFrame:
    """Which block a label cluster is: share of known numbers times closeness to the block's
    pins, vetoed by a runner-up nearly as good. The lots of the assigned clusters refit their page, together with
    its ``seeds`` (map_id, x, y, e, n), and the clusters are assigned again under the new transform. Clusters left
    over whose numbers fit exactly one block are taken by their numbers alone. ``pins``: map_id, block, e, n, lot_n."""
    t = transform.select("map_id", *T6)
    compat = written(cluster_compat(clusters, domain), "compat")
    first = _by_pins(_pin_distance(clusters, compat, pins, t, far), sigma, far, veto)
    if "lot_n" in pins.columns:
        none = t.sparkSession.createDataFrame([], clusters.select("map_id", "x", "y", F.lit(0.0).alias("e"), F.lit(0.0).alias("n")).schema)
        t = written(refit_by_lots(lot_pairs(clusters, domain, pins, first), none if seeds is None else seeds, t), "refit")
    md = written(_pin_distance(clusters, compat, pins, t, far), "pin-distance")
    sure = _by_pins(md, sigma, far, veto).withColumn("how", F.lit("pins"))
    anchored = pins.select("map_id", "block").distinct().withColumn("_p", F.lit(True))
    left = compat.join(sure.select("map_id", "cluster"), ["map_id", "cluster"], "left_anti").join(anchored, ["map_id", "block"], "left") \
        .join(md.select("map_id", "cluster", "block", "mdist"), ["map_id", "cluster", "block"], "left") \
        .filter((F.col("share") >= 0.8) & (F.col("_p").isNull() | (F.col("mdist") <= far)))
    wl = Window.partitionBy("map_id", "cluster").orderBy(F.desc("share"), "block")
    lone = left.withColumn("_r", F.row_number().over(wl)).filter("_r <= 2").groupBy("map_id", "cluster").agg(
        F.max(F.when(F.col("_r") == 1, F.col("block"))).alias("block"), F.max(F.when(F.col("_r") == 2, F.col("share"))).alias("s2"))
    centre = clusters.select("map_id", "cluster", "cx", "cy").distinct().join(t, "map_id")
    inside = centre.filter(F.sqrt(F.pow(F.expr("a * cx + b * cy + c"), 2) + F.pow(F.expr("d * cx + f * cy + g"), 2)) <= 500).select("map_id", "cluster")
    lone = lone.filter("s2 IS NULL OR s2 <= 0.4").join(inside, ["map_id", "cluster"], "left_semi").select("map_id", "cluster", "block", F.lit("numbers").alias("how"))
    return sure.unionByName(lone)


def fit_similarity(pairs: DataFrame, group: list[str] = ("map_id",)) -> DataFrame:
    """Rotation, scale and shift x, y -> e, n per group, from centred sums."""
    g = pairs.groupBy(*group).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("e").alias("me"), F.avg("n").alias("mn"),
        (F.covar_pop("x", "e") + F.covar_pop("y", "n")).alias("_p"), (F.covar_pop("x", "n") - F.covar_pop("y", "e")).alias("_q"), (F.var_pop("x") + F.var_pop("y")).alias("_v"))
    g = g.filter(F.col("_v") > 1e-9).withColumns({"sc": F.expr("_p / _v"), "ss": F.expr("_q / _v")})
    g = g.filter(F.sqrt(F.expr("sc * sc + ss * ss")).between(0.1, 3))
    return g.select(*group, F.col("sc").alias("a"), (-F.col("ss")).alias("b"), F.expr("me - sc * mx + ss * my").alias("c"), F.col("ss").alias("d"),
                    F.col("sc").alias("f"), F.expr("mn - ss * mx - sc * my").alias("g"))


def similarity_consensus(clusters: DataFrame, domain: DataFrame, centroids: DataFrame, reach: float = 40, min_cluster: int = 25, rounds: int = 3, top: int = 16) -> DataFrame:
    """Global placement of a page: big clusters that could be pinned blocks are seeds. Two seeds give a rotation
    and scale (small rotation, plausible scale), which are put to the vote; under each of the ``top`` ones every
    seed votes for a shift. The pose that explains most labels over at least five blocks wins, refined on what
    it explains. A page costs the square of its seeds at most. ``centroids``: map_id, block, e, n."""
    big = clusters.filter(F.col("size") >= min_cluster).select("map_id", "cluster", "size", "max_num", "cx", "cy").distinct()
    dom = domain.groupBy("map_id", "block").agg(F.count_distinct("num").alias("d_size"), F.max("num").alias("d_max"))
    comp = cluster_compat(clusters.join(big.select("map_id", "cluster"), ["map_id", "cluster"], "left_semi"), domain).filter("share >= 0.75")
    seeds = comp.join(big, ["map_id", "cluster"]).join(dom, ["map_id", "block"]).join(centroids, ["map_id", "block"]) \
        .filter("size <= d_size * 1.3 AND max_num >= d_max * 0.35")
    seeds = seeds.select("map_id", "cluster", "block", "size", F.col("cx").alias("x"), F.col("cy").alias("y"), "e", "n")
    seeds = written(seeds, "seeds")
    span = lambda df, u, v, out: df.groupBy("map_id").agg(F.sqrt(F.pow(F.max(u) - F.min(u), 2) + F.pow(F.max(v) - F.min(v), 2)).alias(out))
    scale0 = span(centroids, "e", "n", "_se").join(span(big, "cx", "cy", "_sp"), "map_id").select("map_id", F.try_divide("_se", "_sp").alias("scale0"))
    numbered = seeds.withColumn("_i", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("size"), "cluster", "block")))
    two = dealt_pairs(numbered, ["map_id"], ["cluster", "block", "x", "y", "e", "n"]).filter("cluster0 <> cluster1 AND block0 <> block1")
    two = once(two, {"dx": F.expr("x1 - x0"), "dy": F.expr("y1 - y0"), "de": F.expr("e1 - e0"), "dn": F.expr("n1 - n0")})
    turn = two.withColumn("_v", F.expr("dx * dx + dy * dy")).filter("_v > 1e-9").select("map_id", F.expr("(dx * de + dy * dn) / _v").alias("a"), F.expr("(dx * dn - dy * de) / _v").alias("d"))
    length = F.sqrt(F.expr("a * a + d * d"))
    turn = turn.join(scale0, "map_id").filter(length.between(0.1, 3) & length.between(F.col("scale0") * 0.55, F.col("scale0") * 1.8) & (F.abs(F.degrees(F.atan2("d", "a"))) <= 12))
    # cells of a twentieth of the expected scale, which is three degrees across
    relative = turn.select("map_id", (F.col("a") / F.col("scale0")).alias("a"), (F.col("d") / F.col("scale0")).alias("d"))
    turns = peaks(relative, ["map_id"], "a", "d", F.lit(0.05), top).join(scale0, "map_id").select(
        "map_id", F.col("peak").alias("turn"), (F.col("a") * F.col("scale0")).alias("a"), (F.col("d") * F.col("scale0")).alias("d"))
    turns = written(turns, "turns")
    shifts = seeds.join(turns, "map_id").select("map_id", "turn", F.expr("e - a * x + d * y").alias("c"), F.expr("n - d * x - a * y").alias("g"))
    shifts = peaks(shifts, ["map_id", "turn"], "c", "g", F.lit(reach), 2)
    hyp = turns.join(shifts, ["map_id", "turn"]).select("map_id", "turn", "peak", "a", (-F.col("d")).alias("b"), "c", "d", F.col("a").alias("f"), "g")

    def explain(t, keys):
        hit = t.join(seeds, "map_id").withColumn("dist", residual()).filter(F.col("dist") <= reach)
        return hit.groupBy(*keys, *T6, "cluster").agg(F.min_by(F.struct("block", "size", "x", "y", "e", "n"), F.struct("dist", "block")).alias("s"))

    counts = (F.count_distinct("s.block").alias("n_blocks"), F.sum("s.size").alias("score"))
    # each pose is first fitted to what it explains, so that those of one peak are compared at their best
    fitted = fit_similarity(explain(hyp, ["map_id", "turn", "peak"]).select("map_id", "turn", "peak", "s.*"), ["map_id", "turn", "peak"])
    won = explain(fitted, ["map_id", "turn", "peak"]).groupBy("map_id", "turn", "peak", *T6).agg(*counts).filter("n_blocks >= 5")
    best = won.groupBy("map_id").agg(F.min_by(F.struct(*T6, "n_blocks", "score"), F.struct(-F.col("score"), "turn", "peak")).alias("t")).select("map_id", "t.*")
    for _ in range(rounds):
        best = written(best, "similarity")
        inl = explain(best.select("map_id", *T6), ["map_id"]).select("map_id", "s.*")
        better = fit_similarity(inl)
        stat = explain(better, ["map_id"]).groupBy("map_id", *T6).agg(*counts)
        best = stat.unionByName(best.join(stat.select("map_id"), "map_id", "left_anti"))
    return best


# ---------------------------------------------------------------- checks

def validate_blocks(entries: DataFrame, pins: DataFrame, max_m: float = 22) -> DataFrame:
    """Drawn lots that may stay: keys drawn once, in blocks whose median pin lies within
    ``max_m`` of a drawn lot. ``entries``: map_id, block, lot, e, n; ``pins``: map_id, block,
    e, n. Nearest lots are searched in cells of the gate's size; farther is simply too far."""
    once_ = entries.groupBy("map_id", "block", "lot").agg(F.count("*").alias("_c"), F.min("e").alias("e"), F.min("n").alias("n")).filter("_c = 1").drop("_c")
    cell = lambda c: F.floor(F.col(c) / max_m)
    nine = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    drawn = once_.withColumn("_k", F.explode(nine)).select("map_id", "block", (cell("e") + F.col("_k.i")).alias("_cx"), (cell("n") + F.col("_k.j")).alias("_cy"),
                                                           F.col("e").alias("de"), F.col("n").alias("dn"))
    p = pins.groupBy("map_id", "block", "e", "n").agg(F.count("*").alias("k")).withColumns({"_cx": cell("e"), "_cy": cell("n")})
    p = p.join(once_.select("map_id", "block").distinct(), ["map_id", "block"], "left_semi")
    d = p.join(drawn, ["map_id", "block", "_cx", "_cy"], "left").groupBy("map_id", "block", "e", "n", "k").agg(
        F.min(geo.dist(F.col("e"), F.col("n"), F.col("de"), F.col("dn"))).alias("d"))
    # a median within the gate only asks whether fewer than half of the pins are beyond it
    q = d.groupBy("map_id", "block").agg(F.sum("k").alias("n_pins"), F.sum(F.when(F.col("d") <= max_m, F.col("k")).otherwise(0)).alias("n_near"))
    bad = q.filter(F.col("n_near") <= F.floor(F.col("n_pins") / 2))
    return once_.join(bad.select("map_id", "block"), ["map_id", "block"], "left_anti")


def sheet_poses(pairs: DataFrame, step: float = 0.4, axis_peaks: int = 8, other_peaks: int = 4, scales: tuple[float, float] = (0.5, 25), near_m: float = 12) -> DataFrame:
    """Affine poses (map_id, axis, one, two, a..g) of sheets measured in cells. Cells of one column show what a
    step down is on the ground, cells of one row what a step to the right is; the likeliest of these are found by
    vote. Under each, any two cells vote for the other step, and under both every cell votes for the shift.
    ``pairs``: map_id, cell, x, y, e, n; a sheet costs the square of its pairs at most."""
    able = lambda p, q: F.sqrt(p * p + q * q).between(*scales)
    items = pairs.select("map_id", "cell", "x", "y", "e", "n").withColumn("_i", F.row_number().over(Window.partitionBy("map_id").orderBy("cell", "e", "n")))
    two = dealt_pairs(items, ["map_id"], ["cell", "x", "y", "e", "n"]).filter("cell0 <> cell1")
    two = written(two.select("map_id", F.expr("x1 - x0").alias("dx"), F.expr("y1 - y0").alias("dy"), F.expr("e1 - e0").alias("de"), F.expr("n1 - n0").alias("dn")), "cell-steps")
    along = lambda name, d, o: two.filter(f"{o} = 0 AND {d} <> 0").select("map_id", F.lit(name).alias("axis"), F.expr(f"de / {d}").alias("p"), F.expr(f"dn / {d}").alias("q"))
    first = along("x", "dx", "dy").unionByName(along("y", "dy", "dx")).filter(able(F.col("p"), F.col("q")))
    first = written(peaks(first, ["map_id", "axis"], "p", "q", F.lit(step), axis_peaks).withColumnRenamed("peak", "one").drop("votes"), "first-step")
    across = lambda name, d, o: two.filter(f"{o} <> 0").join(first.filter(F.col("axis") == name), "map_id").select(
        "map_id", "axis", "one", "p", "q", F.expr(f"(de - p * {d}) / {o}").alias("r"), F.expr(f"(dn - q * {d}) / {o}").alias("s"))
    second = across("x", "dx", "dy").unionByName(across("y", "dy", "dx")).filter(able(F.col("r"), F.col("s")))
    second = peaks(second, ["map_id", "axis", "one", "p", "q"], "r", "s", F.lit(step), other_peaks).withColumnRenamed("peak", "two").drop("votes")
    is_x = F.col("axis") == "x"
    pick = lambda x, y: F.when(is_x, F.col(x)).otherwise(F.col(y))
    linear = written(second.select("map_id", "axis", "one", "two", pick("p", "r").alias("a"), pick("r", "p").alias("b"), pick("q", "s").alias("d"), pick("s", "q").alias("f")), "both-steps")
    shift = pairs.select("map_id", "x", "y", "e", "n").join(linear, "map_id").select("map_id", "axis", "one", "two", F.expr("e - a * x - b * y").alias("c"), F.expr("n - d * x - f * y").alias("g"))
    shift = peaks(shift, ["map_id", "axis", "one", "two"], "c", "g", F.lit(near_m), 1).drop("peak", "votes")
    return linear.join(shift, ["map_id", "axis", "one", "two"]).select("map_id", "axis", "one", "two", *T6)


def place_sheets(pairs: DataFrame, near_m: float = 12, tight_m: float = 10, least: int = 6, rounds: int = 3, loose_m: float = 15) -> DataFrame:
    """map_id, used, residual, quality, a..g: the pose that most cells agree with, a cell having one vote for the
    nearest of its places; at least ``least`` must. It is fitted to its cells and to those it explains then, while
    there are enough. A sheet whose median residual is above ``loose_m`` is not placed."""
    def winners(t, within, keys=()):
        near = pairs.join(t.select("map_id", *keys, *T6), "map_id").withColumn("_d", residual()).filter(F.col("_d") <= within)
        return near.groupBy("map_id", *keys, "cell", *T6).agg(F.min_by(F.struct("x", "y", "e", "n", "w", F.col("_d").alias("dist")), F.struct("_d", "e", "n")).alias("p"))

    key = ["axis", "one", "two"]
    # each pose is first fitted to its cells, so that those of one peak are compared at their best
    fitted = fit_affine(winners(sheet_poses(pairs, near_m=near_m), near_m, key).select("map_id", *key, "p.*"), ["map_id", *key])
    votes = winners(fitted, near_m, key).groupBy("map_id", *key, *T6).agg(F.count("*").alias("used")).filter(F.col("used") >= least)
    best = votes.groupBy("map_id").agg(F.min_by(F.struct(*T6), F.struct(-F.col("used"), *key)).alias("t")).select("map_id", "t.*")
    won = winners(best, near_m)
    for _ in range(rounds):
        won = written(won, "sheet-cells")
        again = winners(fit_affine(won.select("map_id", "p.*"), least=least), tight_m)
        enough = again.groupBy("map_id").agg(F.count("*").alias("_c")).filter(F.col("_c") >= least).select("map_id")
        won = again.join(enough, "map_id", "left_semi").unionByName(won.join(enough, "map_id", "left_anti"))
    won = written(won.select("map_id", *T6, F.round("p.dist", 4).alias("dist")), "sheet-cells")
    median = pick_at(won, ["map_id"], "dist", F.floor(F.col("n") / 2), "residual").select("map_id", F.round("residual", 1).alias("residual"), F.col("n").alias("used"))
    grade = F.when(F.col("residual") <= 6, "good").when(F.col("residual") <= 12, "fair").otherwise("approx")
    return won.select("map_id", *T6).distinct().join(median.filter(F.col("residual") <= loose_m), "map_id").select("map_id", "used", "residual", grade.alias("quality"), *T6)


def cell_pairs(cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """Cells whose lot number occurs once on their sheet, with every fitted lot of that number."""
    uniq = cells.groupBy("map_id", "lot").agg(F.count("*").alias("_c"), F.min("cell").alias("cell"), F.min("x").alias("x"), F.min("y").alias("y")).filter("_c = 1")
    return uniq.join(fitted, ["map_id", "lot"]).select("map_id", "cell", "x", "y", "e", "n", F.lit(1.0).alias("w"))


def explain_cells(cells: DataFrame, fitted: DataFrame, register_lots: DataFrame, pins: DataFrame, near_m: float = 12) -> DataFrame:
    """Overview sheet: cells (map_id, cell, lot, x, y) whose lot number occurs once are paired
    with every fitted lot of that number, the pose that most cells agree with places the sheet,
    and cells no fitted lot explains are claimed by the first target section that has such a
    lot. A section whose own pins disagree (median over 25 m of at least two) is refused.
    ``fitted``: map_id, lot, e, n; ``register_lots``: map_id, section, prio, lot; ``pins``:
    map_id, section, lot, e, n."""
    fit = written(place_sheets(written(cell_pairs(cells, fitted), "cell-pairs"), near_m), "sheet-fit")
    placed = cells.join(fit.select("map_id", *T6), "map_id").withColumns({"we": F.expr("a * x + b * y + c"), "wn": F.expr("d * x + f * y + g")}).drop(*T6)
    known = placed.join(fitted.select("map_id", "lot", F.col("e").alias("fe"), F.col("n").alias("fn")), ["map_id", "lot"]) \
        .filter(geo.dist(F.col("fe"), F.col("fn"), F.col("we"), F.col("wn")) < near_m).select("map_id", "cell").distinct()
    free = placed.join(known, ["map_id", "cell"], "left_anti")
    claim = free.join(register_lots, ["map_id", "lot"]).groupBy("map_id", "cell", "lot", "x", "y", "we", "wn").agg(F.min_by("section", "prio").alias("section"))
    check = claim.join(pins, ["map_id", "section", "lot"]).withColumn("_d", F.round(geo.dist(F.col("e"), F.col("n"), F.col("we"), F.col("wn")), 2)) \
        .groupBy("map_id", "section").agg(F.count("*").alias("_n"), geo.median_upper("_d").alias("_m")).filter("_n >= 2 AND _m > 25")
    claimed = claim.join(check.select("map_id", "section"), ["map_id", "section"], "left_anti").select("map_id", "cell", "lot", F.lit("claimed").alias("state"), "section")
    both = claimed.unionByName(known.join(cells.select("map_id", "cell", "lot"), ["map_id", "cell"]).select("map_id", "cell", "lot", F.lit("explained").alias("state"), F.lit(None).cast("string").alias("section")))
    return both.join(fit.select("map_id", "residual", "quality"), "map_id").select("map_id", "cell", "lot", "state", "section", "residual", "quality")
