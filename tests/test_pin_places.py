"""Equal pairs of a map are tested against each hypothesis once and counted as often as they occur."""

from plotlink.operators import georef as gr


def _pairs(spark, times):
    at = [(x, y, 2.0 * x + 1 + (40 if (x + y) % 90 == 0 else 0), 2.0 * y - 3) for x in range(0, 200, 50) for y in range(0, 200, 40)]
    return spark.createDataFrame([(1, k * 100 + i, float(x), float(y), float(e), float(n), 1.0) for k in range(times) for i, (x, y, e, n) in enumerate(at)],
                                 "map_id int, ord long, x double, y double, e double, n double, w double")


def test_equal_pairs_are_tested_once(spark):
    pairs = _pairs(spark, 50)
    out = gr.ransac_affine(pairs).collect()
    assert len(out) == 1 and out[0].used == pairs.filter("e = 2 * x + 1").count()
    assert abs(out[0].a - 2) < 1e-6 and abs(out[0].c - 1) < 1e-6
    places = gr._places(pairs, ["map_id"])
    assert places.count() == 20 and {r._same for r in places.collect()} == {50}
