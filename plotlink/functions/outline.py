"""Points and outlines by a grid of edges, so a point meets the edges near it and not its cemetery's outlines.

Whether a point lies inside is the parity of the edges above it, which all cross the strip of longitude it
stands in; how far it is from an outline is asked only of edges whose cells reach it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import geo

#: Width of a strip in degrees of longitude, some 40 m at middle latitudes.
STRIP = 0.0005


def edges_of(vertices: DataFrame, poly: str) -> DataFrame:
    """cem_id, poly, and each edge from a vertex (yi, xi) to the one before it (yj, xj), the last closing the outline."""
    w = Window.partitionBy("cem_id", poly).orderBy("v")
    here = F.struct("lat", "lng")
    closing = F.last(here).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = vertices.select("cem_id", F.col(poly).alias("poly"), "lat", "lng", F.coalesce(F.lag(here).over(w), closing).alias("_o"))
    return e.select("cem_id", "poly", F.col("lat").alias("yi"), F.col("lng").alias("xi"), F.col("_o.lat").alias("yj"), F.col("_o.lng").alias("xj"))


def _cells(lo: Column, hi: Column, size: float, more: int = 0) -> Column:
    return F.explode(F.sequence(F.floor(lo / size) - more, F.floor(hi / size) + more))


def inside(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """The keys of the points (cem_id, lat, lng and ``key``) that lie in an outline of their cemetery."""
    strips = edges.filter("xi <> xj").withColumn("_s", _cells(F.least("xi", "xj"), F.greatest("xi", "xj"), STRIP))
    j = points.select(*key, "lat", "lng", F.floor(F.col("lng") / STRIP).alias("_s")).join(strips, ["cem_id", "_s"])
    over = (F.col("xi") > F.col("lng")) != (F.col("xj") > F.col("lng"))
    cut = F.expr("(yj - yi) * try_divide(lng - xi, xj - xi) + yi")
    odd = j.filter(over & (F.col("lat") < cut)).groupBy(*key, "poly").agg((F.count("*") % 2 == 1).alias("_odd"))
    return odd.filter("_odd").select(*key).distinct()


def near_edge(points: DataFrame, edges: DataFrame, key: list[str], reach_m: float) -> DataFrame:
    """key, dist_m of the points at most ``reach_m`` from an edge. Cells are as large as the reach up to 80 degrees of latitude."""
    c_lat, c_lng = reach_m / geo.M_PER_DEG * 1.001, reach_m / (geo.M_PER_DEG * 0.17)
    filed = edges.withColumn("_cy", _cells(F.least("yi", "yj"), F.greatest("yi", "yj"), c_lat, 1)).withColumn("_cx", _cells(F.least("xi", "xj"), F.greatest("xi", "xj"), c_lng, 1))
    j = points.select(*key, "lat", "lng", F.floor(F.col("lat") / c_lat).alias("_cy"), F.floor(F.col("lng") / c_lng).alias("_cx")).join(filed, ["cem_id", "_cy", "_cx"])
    m, kx = F.lit(geo.M_PER_DEG), F.lit(geo.M_PER_DEG) * F.cos(F.radians("lat"))
    j = j.withColumns({"_vx": F.expr("xi - xj") * kx, "_vy": F.expr("yi - yj") * m, "_px": F.expr("lng - xj") * kx, "_py": F.expr("lat - yj") * m})
    j = j.withColumn("_l", F.expr("_vx * _vx + _vy * _vy"))
    j = j.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr("(_px * _vx + _py * _vy) / CASE WHEN _l = 0 THEN 1 ELSE _l END"))))
    far = F.sqrt(F.pow(F.expr("_px - _t * _vx"), 2) + F.pow(F.expr("_py - _t * _vy"), 2))
    return j.groupBy(*key).agg(F.min(far).alias("dist_m")).filter(F.col("dist_m") <= reach_m)


def near_vertex(points: DataFrame, vertices: DataFrame, key: list[str], pad: float) -> DataFrame:
    """The keys of the points less than ``pad`` degrees from a vertex either way."""
    nine = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    cell = lambda c: F.floor(F.col(c) / pad)
    filed = vertices.select("cem_id", F.col("lat").alias("_a"), F.col("lng").alias("_b")).distinct().withColumn("_k", nine) \
        .select("cem_id", "_a", "_b", (cell("_a") + F.col("_k.i")).alias("_cy"), (cell("_b") + F.col("_k.j")).alias("_cx"))
    j = points.select(*key, F.col("lat").alias("_y"), F.col("lng").alias("_x"), cell("lat").alias("_cy"), cell("lng").alias("_cx")).join(filed, ["cem_id", "_cy", "_cx"])
    return j.filter((F.abs(F.col("_a") - F.col("_y")) < pad) & (F.abs(F.col("_b") - F.col("_x")) < pad)).select(*key).distinct()
