"""Local metre frame, distances and bearings as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotlink import config as C

M_PER_DEG = math.pi / 180 * C.EARTH_M


def haversine(lat1, lng1, lat2, lng2, radius: float = C.EARTH_M) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def east(lng, c_lat, c_lng) -> Column:
    return (lng - c_lng) * (F.lit(M_PER_DEG) * F.cos(F.radians(c_lat)))


def north(lat, c_lat) -> Column:
    return (lat - c_lat) * F.lit(M_PER_DEG)


def to_lat(n, c_lat) -> Column:
    return c_lat + n / F.lit(M_PER_DEG)


def to_lng(e, c_lat, c_lng) -> Column:
    return c_lng + e / (F.lit(M_PER_DEG) * F.cos(F.radians(c_lat)))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def dist(e1, n1, e2, n2) -> Column:
    return F.sqrt((e1 - e2) * (e1 - e2) + (n1 - n2) * (n1 - n2))


def median_upper(c: str) -> Column:
    """Upper middle element. The aggregate keeps one counter per distinct value; callers
    round to 0.1 mm, so a hot group is bounded by the ground it covers, not by its rows."""
    return F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)".format(c))
