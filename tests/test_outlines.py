"""Points against outlines of thousands of vertices, edge by edge."""

import math
import random

from plotlink.functions import geo
from plotlink.operators import burials
from plotlink.sources import places

LAT, LNG = 43.2, -84.4


def outline(n, seed, size=0.004):
    rng = random.Random(seed)
    spokes = [size * (0.6 + 0.3 * math.sin(5 * 2 * math.pi * i / n) + 0.05 * rng.random()) for i in range(n)]
    return [(LAT + r * math.sin(2 * math.pi * i / n), LNG + 1.3 * r * math.cos(2 * math.pi * i / n)) for i, r in enumerate(spokes)]


def inside(p, ring):
    (y, x), odd = p, False
    for i, (yi, xi) in enumerate(ring):
        yj, xj = ring[i - 1]
        if (xi > x) != (xj > x) and y < (yj - yi) * (x - xi) / (xj - xi) + yi:
            odd = not odd
    return odd


def distance(p, ring):
    (y, x), m = p, geo.M_PER_DEG
    kx, best = m * math.cos(math.radians(p[0])), 1e12
    for i, (yi, xi) in enumerate(ring):
        yj, xj = ring[i - 1]
        vx, vy, px, py = (xi - xj) * kx, (yi - yj) * m, (x - xj) * kx, (y - yj) * m
        t = max(0.0, min(1.0, (px * vx + py * vy) / (vx * vx + vy * vy or 1)))
        best = min(best, math.hypot(px - t * vx, py - t * vy))
    return best


def test_bounds_equal_brute_force(spark):
    rings = {(1, 0): outline(3000, 1), (1, 1): [(a + 0.012, b) for a, b in outline(7, 2)], (2, 0): outline(2500, 3), (3, 0): [(LAT, LNG), (LAT, LNG + 0.001), (LAT + 0.0002, LNG + 0.001)]}
    rng = random.Random(4)
    points = [(c, c, i, LAT + rng.uniform(-0.006, 0.016), LNG + rng.uniform(-0.008, 0.008)) for c in (1, 2, 3, 9) for i in range(150)] + [(1, 1, 999, None, None)]
    df = spark.createDataFrame(points, "cem_id int, map_id int, ord int, lat double, lng double")
    vertices = spark.createDataFrame([(c, p, v, y, x) for (c, p), ring in rings.items() for v, (y, x) in enumerate(ring)], "cem_id int, poly int, v int, lat double, lng double")
    got = {(r["cem_id"], r["ord"]): (r["outside"], r["off_m"]) for r in burials.out_of_bounds(df, vertices).collect()}
    assert len(got) == len(points)
    n_near = 0
    for c, _, i, y, x in points:
        own = [ring for (k, _), ring in rings.items() if k == c]
        if y is None or not own:
            assert got[c, i] == (False, None)
            continue
        off = 0.0 if any(inside((y, x), r) for r in own) else min(distance((y, x), r) for r in own)
        n_near += 0 < off <= 25
        assert got[c, i][0] == (off > 25) and (got[c, i][1] is None if off > 25 else abs(got[c, i][1] - off) < 1e-6)
    assert n_near > 3


def test_touching_equals_brute_force(spark):
    ring, rng, pad = outline(2000, 5), random.Random(6), 0.0006
    points = [(1, 5, v, LAT + rng.uniform(-0.006, 0.006), LNG + rng.uniform(-0.008, 0.008)) for v in range(200)] + [(2, 6, v, LAT + v * 0.00025, LNG) for v in range(6)]
    df = spark.createDataFrame(points, "cem_id int, el_id long, v int, lat double, lng double")
    bounds = spark.createDataFrame([(1, 1, v, y, x) for v, (y, x) in enumerate(ring)], "cem_id int, el_id long, v int, lat double, lng double")
    got = {(r["cem_id"], r["v"]): (r["touch"], r["has_area"]) for r in places._touching(df, bounds, spark.createDataFrame([(1, LAT, LNG), (2, LAT, LNG)], "cem_id int, lat double, lng double"), pad).collect()}
    for c, _, v, y, x in points:
        if c == 1:
            assert got[c, v] == (inside((y, x), ring) or any(abs(a - y) < pad and abs(b - x) < pad for a, b in ring), True)
        else:
            assert got[c, v] == (v < 3, False)
