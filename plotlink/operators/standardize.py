"""Table-wide standardisation jobs: names, years, plots, pins, projections, tiles."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions import dates, geo, names, plots
from plotlink.functions.frames import once


def standardize_names(df: DataFrame, name_col: str = "name", alt_col: str | None = None) -> DataFrame:
    return names.name_keys(df, name_col, alt_col)


def extract_years(df: DataFrame, birth: str = "bd", death: str = "dd", burial: str = "burial") -> DataFrame:
    """by and dy from free text; dyb marks a death year that really is the burial year."""
    df = once(df, {
        "by": dates.year_of(F.col(birth)),
        "_d": dates.year_of(F.col(death)),
        "_b": dates.year_of(F.col(burial)),
    })
    d, b = F.col("_d"), F.col("_b")
    return df.withColumns({
        "dy": F.when(d != 0, d).otherwise(b),
        "dyb": (d == 0) & (b != 0),
    }).drop("_d", "_b")


def standardize_plots(df: DataFrame, plot_col: str = "plot") -> DataFrame:
    return plots.parse_generic(df, plot_col)


def plot_parse_counts(df: DataFrame, plot_col: str = "plot") -> DataFrame:
    """Per cemetery: rows, rows with plot text, rows parsed, rows not parsed."""
    parsed = plots.parse_generic(df, plot_col)
    text = F.coalesce(F.col(plot_col), F.lit("")) != ""
    return parsed.groupBy("cem_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(text).alias("n_text"),
        F.count_if(F.col("section").isNotNull()).alias("n_parsed"),
        F.count_if(text & F.col("section").isNull()).alias("n_unparsed"),
    )


def standardize_plots_aliased(df: DataFrame, plot_col: str = "plot", aliases=None) -> DataFrame:
    return plots.parse_aliased(df, plot_col, aliases)


def decode_plot_codes(df: DataFrame, code_col: str = "code", code_table: DataFrame | None = None) -> DataFrame:
    return plots.decode_code(df, code_col, code_table)


def plot_keys(df: DataFrame) -> DataFrame:
    """Adds lot_key, lot_n and the two parts of the plot key to rows with plot parts."""
    group_sub, group_block = plots.plot_group(F.col("section"), F.col("sub"), F.col("block"))
    return once(df, {
        "sub": F.coalesce("sub", F.lit("")),
        "block": plots.norm_block(F.col("block")),
        "lot_key": plots.lot_key(F.col("lot")),
        "lot_n": plots.int_prefix(F.col("lot")),
        "group_sub": group_sub,
        "group_block": plots.norm_block(group_block),
    })


def clean_pins(df: DataFrame, cemetery: DataFrame, lo: float = 5, hi: float = 800) -> DataFrame:
    """Nulls pins nearer than ``lo`` or farther than ``hi`` metres from their cemetery's
    centroid, says why, and projects the survivors to local east/north metres."""
    cem = cemetery.select("cem_id", F.col("lat").alias("_clat"), F.col("lng").alias("_clng"))
    d = F.col("_d")
    out = df.join(cem, "cem_id").withColumn(
        "_d", geo.haversine(F.col("lat"), F.col("lng"), F.col("_clat"), F.col("_clng"))
    )
    ok = d.between(lo, hi)
    return out.withColumns({
        "reason": F.when(d.isNull(), "none").when(d < lo, "centroid").when(d > hi, "off_site").otherwise("ok"),
        "pin_lat": F.when(ok, F.col("lat")),
        "pin_lng": F.when(ok, F.col("lng")),
        "e": F.when(ok, geo.east(F.col("lng"), F.col("_clat"), F.col("_clng"))),
        "n": F.when(ok, geo.north(F.col("lat"), F.col("_clat"))),
    }).drop("_d", "_clat", "_clng")


def distance_label(m) -> "F.Column":
    ft = m * 3.28084
    mi = m / 1609.344
    mile = F.when(mi >= 10, F.format_string("%d", geo.half_up(mi))) \
        .when(mi < 2, F.format_string("%.2f", mi)).otherwise(F.format_string("%.1f", mi))
    return F.when(ft < 1000, F.format_string("%d ft", geo.half_up(ft))).otherwise(F.concat(mile, F.lit(" mi")))


def approach_table(positions: DataFrame, located: DataFrame) -> DataFrame:
    """Each observer and the one grave they walk to: distance, bearing, compass point,
    inside-the-search-circle flag. One row per observer, joined on the grave's key."""
    tgt = located.select("cem_id", "mid", F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng"), "acc")
    df = positions.join(tgt, ["cem_id", "mid"])
    df = df.withColumns({
        "dist_m": geo.haversine(F.col("lat"), F.col("lng"), F.col("t_lat"), F.col("t_lng")),
        "bearing": geo.bearing(F.col("lat"), F.col("lng"), F.col("t_lat"), F.col("t_lng")),
    })
    points = F.array(*[F.lit(p) for p in C.COMPASS])
    return df.withColumns({
        "point": F.get(points, (geo.half_up(F.col("bearing") / 22.5) % 16).cast("int")),
        "inside": F.col("dist_m") <= F.greatest(F.lit(8), F.col("acc")),
        "label": distance_label(F.col("dist_m")),
    })


def project_plats(plat_map: DataFrame, plat_entry: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Every plat entry through its map's affine to metres and on to degrees."""
    cem = cemetery.select("cem_id", F.col("lat").alias("_clat"), F.col("lng").alias("_clng"))
    df = plat_entry.join(plat_map.drop("cem_id"), "map_id").join(cem, "cem_id")
    df = df.withColumns({
        "e": F.expr("a * x + b * y + c"),
        "n": F.expr("d * x + f * y + g"),
    })
    return df.withColumns({
        "lat": geo.to_lat(F.col("n"), F.col("_clat")),
        "lng": geo.to_lng(F.col("e"), F.col("_clat"), F.col("_clng")),
    }).drop("_clat", "_clng")


def _tile(z, lat, lng):
    n = F.pow(F.lit(2.0), z)
    r = F.radians(lat)
    return (
        F.floor((lng + 180) / 360 * n).cast("int"),
        F.floor((1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.lit(math.pi)) / 2 * n).cast("int"),
    )


def _cover(boxes: DataFrame, zooms) -> DataFrame:
    z = F.col("z")
    df = boxes.withColumn("z", F.explode(F.array(*[F.lit(i) for i in zooms])))
    x0, y0 = _tile(z, F.col("n_lat"), F.col("w_lng"))
    x1, y1 = _tile(z, F.col("s_lat"), F.col("e_lng"))
    return df.withColumn("x", F.explode(F.sequence(F.least(x0, x1), F.greatest(x0, x1)))) \
        .withColumn("y", F.explode(F.sequence(F.least(y0, y1), F.greatest(y0, y1)))) \
        .select("z", "x", "y")


def tile_cover(cemetery: DataFrame, points: DataFrame, cached: DataFrame, zooms=(15, 16, 17, 18, 19)) -> DataFrame:
    """Distinct map tiles over the grounds (a radius from the number of interments) and
    over the mapped points (their box padded by 120 m), with mercator box, minus cached."""
    radius = F.least(F.lit(650.0), F.greatest(F.lit(300.0), 250.0 + F.sqrt(F.greatest(F.col("interments"), F.lit(1))) * 6.0))
    dlat = radius / 110540.0
    dlng = radius / (111320.0 * F.cos(F.radians("lat")))
    grounds = cemetery.select(
        (F.col("lat") + dlat).alias("n_lat"), (F.col("lat") - dlat).alias("s_lat"),
        (F.col("lng") - dlng).alias("w_lng"), (F.col("lng") + dlng).alias("e_lng"),
    )
    box = points.groupBy("cem_id").agg(
        F.max("lat").alias("hi_lat"), F.min("lat").alias("lo_lat"),
        F.max("lng").alias("hi_lng"), F.min("lng").alias("lo_lng"),
    )
    pad = 120 / 111194
    pad_lng = pad / F.cos(F.radians("lat"))
    mapped = cemetery.join(box, "cem_id", "left").select(
        (F.greatest("lat", "hi_lat") + pad).alias("n_lat"), (F.least("lat", "lo_lat") - pad).alias("s_lat"),
        (F.least("lng", "lo_lng") - pad_lng).alias("w_lng"), (F.greatest("lng", "hi_lng") + pad_lng).alias("e_lng"),
    )
    tiles = _cover(grounds, zooms).unionByName(_cover(mapped, zooms)).distinct()
    half = math.pi * C.MERC_R
    size = F.lit(2 * half) / F.pow(F.lit(2.0), F.col("z"))
    return tiles.join(cached, ["z", "x", "y"], "left_anti").withColumns({
        "xmin": -half + F.col("x") * size,
        "ymax": half - F.col("y") * size,
        "xmax": -half + F.col("x") * size + size,
        "ymin": half - F.col("y") * size - size,
    })


def memorial_table(memorial: DataFrame) -> DataFrame:
    """Memorials with link keys and parsed plot parts (the form every later job reads)."""
    df = names.name_keys(memorial, "name", "maiden")
    df = plots.parse_generic(df, "plot")
    return df.withColumn("dyb", F.lit(False))


def register_table(register: DataFrame, sg_blocks=()) -> DataFrame:
    """Register rows with link keys, years and normalised plot parts."""
    from plotlink.operators.maintain import normalize_register

    df = names.name_keys(register, "name", "former")
    df = once(df, {"nm": names.former_surname(F.col("former"))})
    return normalize_register(extract_years(df), sg_blocks)


def request_table(request: DataFrame) -> DataFrame:
    """Requests with link keys and parsed plot parts; missing years are 0 as in memorials."""
    df = once(request, {
        "nl": names.norm_name(F.col("ln")),
        "fr": names.first_token(names.norm_name(F.col("fn"))),
        "nm": F.lit(""),
        "by": F.coalesce("by", F.lit(0)),
        "dy": F.coalesce("dy", F.lit(0)),
        "dyb": F.lit(False),
    }).withColumn("sx", names.soundex_key(F.col("nl")))
    return plots.parse_generic(names.canonical_first(df, "fr", "cf"), "plot")
