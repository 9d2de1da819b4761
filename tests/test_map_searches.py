"""Planted maps: row numbering from either end, offsets without anchors, section centres, the second assignment."""

import math

from pyspark.sql import functions as F

from plotlink.functions import order
from plotlink.operators import georef

PIN = "cem_id int, section string, sub string, block string, lot_n long, e double, n double, w double, ord long"
MAP = "map_id long, cem_id int, section string, style string"


def ground(x, y):
    return 0.4 * x - 0.05 * y + 11, 0.06 * x + 0.45 * y - 7


def test_row_numbering_is_found_from_either_end(spark):
    ways = {1: (1, 0), 2: (1, 2), 3: (-1, 0), 4: (-1, 1)}
    rows, pins = [], []
    for m, (direction, first) in ways.items():
        for r in range(5):
            for lot in range(1, 9):
                x, y = 40.0 * lot + (r * lot) % 3, 60.0 * r + (lot * lot) % 7 + 30 * (r % 2)  # no way fits another by accident
                rows.append((m, r, str(lot), x, y))
                number = r + 1 + first if direction == 1 else 5 - r + first
                if (r + lot) % 2:
                    e, n = ground(x, y)
                    pins.append((m, "S", "", str(number), lot, e, n, 1.0, 1000 * m + 10 * r + lot))
    rows += [(9, r, str(lot), 10.0 * lot, 60.0 * r) for r in range(3) for lot in range(1, 6)]
    maps = spark.createDataFrame([(m, m, "S", "rows") for m in (1, 2, 3, 4, 9)], MAP)
    got = {r["map_id"]: r for r in georef.row_number_search(spark.createDataFrame(rows, "map_id long, row_idx long, lot string, x double, y double"), maps, spark.createDataFrame(pins, PIN)).collect()}
    assert {m: (got[m]["direction"], got[m]["first"]) for m in ways} == ways
    assert all(got[m]["loo"] < 1 and got[m]["n_rows"] == 5 for m in ways)
    assert (got[9]["direction"], got[9]["first"], got[9]["n_tried"], got[9]["n_pairs"]) == (1, 0, 0, 0)  # nobody knows: from the top


def test_bands_without_anchors_take_their_middle(spark):
    label = [(1, str(lot), 6.0, 50.0 + 9 * lot, 80.0 * b + 20) for b in range(3) for lot in range(1, 8)] + [(1, "ABC"[b], 10.0, 60.0, 80.0 * b) for b in range(3)]
    got = georef.band_offset_search(spark.createDataFrame(label, "map_id long, s string, fh double, x double, y double"), spark.createDataFrame([(1, 1, "S", "blocks")], MAP), spark.createDataFrame([], PIN)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 40.0, None, 0)]


def test_maps_without_pairs_stand_on_their_section(spark):
    rot, sc = math.radians(20), 0.5
    place = lambda x, y: (sc * (math.cos(rot) * x - math.sin(rot) * y) + 5, sc * (math.sin(rot) * x + math.cos(rot) * y) - 9)
    spots = [(100.0 * (i % 4) + 13 * (i % 3), 90.0 * (i // 4) + 7 * (i % 5)) for i in range(16)]
    pairs = [(1, i, x, y, *place(x, y), 1.0) for i, (x, y) in enumerate(spots)]
    pairs += [(2, i, x, y, place(x, y)[0] + 300, place(x, y)[1], 1.0) for i, (x, y) in enumerate(spots[:2])]
    pairs = spark.createDataFrame(pairs, "map_id long, ord long, x double, y double, e double, n double, w double")
    fit = georef.ransac_affine(pairs)
    loo = georef.leave_one_out(georef.explained_pairs(pairs, fit))
    label = spark.createDataFrame([(m, x, y) for m in (1, 2, 3) for x, y in spots], "map_id long, x double, y double")
    mx, my = (sum(s[k] for s in spots) / len(spots) for k in (0, 1))
    centroid = spark.createDataFrame([(2, place(mx, my)[0] + 303, place(mx, my)[1]), (3, 40.0, 50.0)], "map_id long, e double, n double")
    got = {r["map_id"]: r for r in georef.fit_trust_fallback(pairs, fit, loo, label, centroid).collect()}
    assert got[1]["quality"] == "good" and got[1]["acc_median"] == 0.0
    assert got[2]["quality"] == "approx" and abs(got[2]["c"] - 306) < 0.01 and got[2]["acc_median"] is None  # two pairs and the centre agree within 15 m
    assert got[3]["quality"] == "rough" and abs(got[3]["a"] * mx + got[3]["b"] * my + got[3]["c"] - 40) < 0.01
    assert {r["map_id"] for r in georef.fit_trust_fallback(pairs, fit, loo).collect()} == {1, 2}


def test_lots_of_assigned_clusters_move_the_page(spark):
    """Blocks A and B are found at once; their lots show that the page lies 30 m off, so C is found too."""
    clusters, dom, pins = [], [], []
    for b, block in enumerate("ABC"):
        for i in range(9):
            x, y = 400.0 * b + 20 * (i % 3), 20.0 * (i // 3)
            num = 100 * b + i
            clusters.append((1, b, str(num), num, x, y, 9, 100 * b + 8, 400.0 * b + 20, 20.0))
            dom.append((1, block, num))
            off = 0.0 if b < 2 else 1.0
            pins.append((1, block, 0.5 * x + 34 + off * 24, 0.5 * y + 3, num))
    t = spark.createDataFrame([(1, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0)], "map_id long, a double, b double, c double, d double, f double, g double")
    clusters = spark.createDataFrame(clusters, "map_id long, cluster long, s string, num long, x double, y double, size long, max_num long, cx double, cy double")
    dom = spark.createDataFrame(dom, "map_id long, block string, num long")
    pins = spark.createDataFrame(pins, "map_id long, block string, e double, n double, lot_n long")
    key = lambda df: {(r["cluster"], r["block"]) for r in df.filter("how = 'pins'").collect()}
    assert key(georef.assign_clusters(clusters, dom, pins.drop("lot_n"), t)) == {(0, "A"), (1, "B")}
    assert key(georef.assign_clusters(clusters, dom, pins, t)) == {(0, "A"), (1, "B"), (2, "C")}
    first = spark.createDataFrame([(1, 0, "A"), (1, 1, "B")], "map_id long, cluster long, block string")
    lots = georef.lot_pairs(clusters, dom, pins, first)
    assert lots.count() == 18
    seeds = spark.createDataFrame([(1, 420.0, 20.0, 244.0, 1013.0)], "map_id long, x double, y double, e double, n double")
    moved = georef.refit_by_lots(lots, seeds.limit(0), t).first()
    assert abs(moved["c"] - 34) < 1e-6 and abs(moved["g"] - 3) < 1e-6
    pulled, want = georef.refit_by_lots(lots, seeds, t).first(), georef.fit_similarity(lots.union(lots).union(lots).union(seeds)).first()
    assert all(abs(pulled[k] - want[k]) < 1e-9 for k in "abcdfg") and abs(pulled["d"]) > 0.001  # a seed counts once, a lot three times
    assert georef.refit_by_lots(lots.limit(5), seeds, t).first()["c"] == 0.0


def test_global_median_by_counts(spark):
    values = [((i * 7919) % 1000) / 10 - 40 for i in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(v for v in values if v is not None)
    for q in (0.0, 0.5, 0.9):
        got = order.pick_global(df, "v", 5.0, F.floor(q * (F.col("n") - 1)), "out").first()["out"]
        assert got == want[int(q * 500)]
    assert order.pick_global(df.limit(0), "v", 5.0, F.lit(0), "out").first()["out"] is None
