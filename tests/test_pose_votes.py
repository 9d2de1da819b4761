"""Poses found by vote: planted ones come back at every size, and the work is the square of a page's seeds."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from plotlink.operators import georef

PAIR = "map_id long, cell string, x double, y double, e double, n double, w double"


def sheet(n_pairs, share, seed, noise=1.5, map_id=1):
    """Cells of a grid with their true place (``share`` of the pairs) or a false one, and the planted transform."""
    rng = random.Random(seed)
    t = dict(a=6.1, b=-1.4, c=35.0, d=1.1, f=3.3, g=-12.0)
    spots = rng.sample([(x, y) for x in range(24) for y in range(60)], n_pairs)
    rows = []
    for i, (x, y) in enumerate(spots):
        e, n = t["a"] * x + t["b"] * y + t["c"] + rng.uniform(-noise, noise), t["d"] * x + t["f"] * y + t["g"] + rng.uniform(-noise, noise)
        if rng.random() > share:
            e, n = rng.uniform(-200, 300), rng.uniform(-100, 400)
        rows.append((map_id, f"c{i:04d}", float(x), float(y), e, n, 1.0))
    return rows, t


@pytest.mark.parametrize("n_pairs", [55, 200, 500])
def test_planted_sheet_is_found(spark, n_pairs):
    rows, t = sheet(n_pairs, 0.35, n_pairs)
    pairs = spark.createDataFrame(rows, PAIR)
    numbered = pairs.withColumn("_i", F.row_number().over(georef.Window.partitionBy("map_id").orderBy("cell")))
    n = georef.dealt_pairs(numbered, ["map_id"], ["cell"]).count()
    assert n == n_pairs * (n_pairs - 1) // 2
    start = time.time()
    got = georef.place_sheets(pairs).collect()
    print(f"{n_pairs} pairs: {n} steps, {time.time() - start:.1f} s")
    assert len(got) == 1 and got[0]["used"] >= 0.3 * n_pairs and got[0]["quality"] == "good"
    # every corner of the sheet stands within the noise
    for x, y in ((0, 0), (23, 0), (0, 59), (23, 59)):
        dx = (got[0]["a"] - t["a"]) * x + (got[0]["b"] - t["b"]) * y + got[0]["c"] - t["c"]
        dy = (got[0]["d"] - t["d"]) * x + (got[0]["f"] - t["f"]) * y + got[0]["g"] - t["g"]
        assert math.hypot(dx, dy) < 2.5


def test_sheets_do_not_disturb_one_another_and_noise_is_no_sheet(spark):
    one, _ = sheet(60, 1.0, 1, noise=0.0)
    rng = random.Random(2)
    none = [(2, f"c{i}", float(rng.randrange(24)), float(rng.randrange(60)), rng.uniform(-5000, 5000), rng.uniform(-5000, 5000), 1.0) for i in range(40)]
    few, _ = sheet(5, 1.0, 3, map_id=3)
    got = georef.place_sheets(spark.createDataFrame(one + none + few, PAIR)).collect()
    assert [(r["map_id"], r["used"], r["residual"]) for r in got] == [(1, 60, 0.0)]
    assert [round(got[0][c], 6) for c in "abcdfg"] == [6.1, -1.4, 35.0, 1.1, 3.3, -12.0]


def test_a_cell_votes_once_and_loose_sheets_are_not_placed(spark):
    rows, _ = sheet(30, 1.0, 5, noise=0.0)
    five = [(m, f"c{i % 5}", *rest) for i, (m, _, *rest) in enumerate(rows)]
    assert georef.place_sheets(spark.createDataFrame(five, PAIR)).count() == 0  # thirty pairs, but five cells
    wide, _ = sheet(200, 1.0, 6, noise=9.0)
    df = spark.createDataFrame(wide, PAIR)
    placed = georef.place_sheets(df, near_m=30, tight_m=30).first()
    assert placed["residual"] > 4 and georef.place_sheets(df, near_m=30, tight_m=30, loose_m=placed["residual"] - 0.1).count() == 0


def page(n_blocks, n_false, seed, rot=0.06, sc=0.42):
    """A page of blocks that all look alike, ``n_blocks`` of them pinned where they belong, and clusters that are nowhere."""
    rng = random.Random(seed)
    clusters, dom, cent = [], [], []
    for b in range(n_blocks + n_false):
        x, y = rng.uniform(0, 900), rng.uniform(0, 900)
        size = 10 + b % 3
        clusters += [(1, b, str(i), i, x, y, size, size - 1, x, y) for i in range(size)]
        e, n = sc * (math.cos(rot) * x - math.sin(rot) * y) + 7, sc * (math.sin(rot) * x + math.cos(rot) * y) - 3
        if b >= n_blocks:
            e, n = rng.uniform(0, 400), rng.uniform(0, 400)
        dom += [(1, f"B{b:03d}", i) for i in range(12)]
        cent.append((1, f"B{b:03d}", e, n))
    return clusters, dom, cent


@pytest.mark.parametrize("n_blocks,n_false", [(6, 2), (11, 4), (16, 7)])
def test_planted_page_is_found_among_all_matches(spark, n_blocks, n_false):
    clusters, dom, cent = page(n_blocks, n_false, n_blocks)
    seeds = (n_blocks + n_false) ** 2  # every cluster could be every block
    start = time.time()
    got = georef.similarity_consensus(
        spark.createDataFrame(clusters, "map_id long, cluster long, s string, num long, x double, y double, size long, max_num long, cx double, cy double"),
        spark.createDataFrame(dom, "map_id long, block string, num long"), spark.createDataFrame(cent, "map_id long, block string, e double, n double"), reach=8, min_cluster=5).collect()
    print(f"{seeds} seeds: {seeds * (seeds - 1) // 2} poses at most, {time.time() - start:.1f} s")
    assert len(got) == 1 and got[0]["n_blocks"] >= n_blocks
    assert abs(got[0]["a"] - 0.42 * math.cos(0.06)) < 0.01 and abs(got[0]["d"] - 0.42 * math.sin(0.06)) < 0.01 and abs(got[0]["c"] - 7) < 4 and abs(got[0]["g"] + 3) < 4


def test_peaks_are_means_of_neighbouring_cells(spark):
    rng = random.Random(9)
    votes = [("u", rng.gauss(2.0, 0.1), rng.gauss(-1.0, 0.1)) for _ in range(80)] + [("u", rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(200)]
    top = georef.peaks(spark.createDataFrame(votes, "g string, p double, q double"), ["g"], "p", "q", F.lit(0.4), 3).orderBy("peak").collect()
    assert len(top) == 3 and top[0]["votes"] >= 78 and abs(top[0]["p"] - 2) < 0.05 and abs(top[0]["q"] + 1) < 0.05
    assert top[0]["votes"] >= top[1]["votes"] >= top[2]["votes"]
