"""A published bundle reads back as what was published, on one page and on many."""

import json

import pytest

from plotlink.plans import publish
from plotlink.sources import feeds

ORDERED = {"request": "prid", "memorial": "mid", "register": "key", "plat_entry": "lot", "ground_vertex": "v", "drive_vertex": "v", "section": "section", "plat_map": "map_ord", "gate": "gate"}


def tables(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    return {
        "cemetery": rows([(1, "North", "Kent", 43.1, -84.5, 2.5, -6.1, "gate@north", "2024-01-02", 1950, ["A", "B"], 77), (2, "Bare", "", 43.2, -84.6, None, -6.6, "", "2024-05-05", None, [], 0)],
                         "cem_id bigint, name string, county string, lat double, lng double, miles double, declination double, contact string, as_of string, register_as_of int, sg_blocks array<string>, interments bigint"),
        "section": rows([(1, "Old", 43.1, -84.5, 30), (1, "New \"x\"", 43.2, -84.4, None)], "cem_id bigint, section string, lat double, lng double, radius int"),
        "plat_map": rows([("1-0", 1, 0, "f", "Old", "", "lots", 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, "good", 3.5), ("1-1", 1, 1, "g", "New", "s", "rows", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, "fair", None)],
                         "map_id string, cem_id bigint, map_ord int, file string, section string, sub string, style string, a double, b double, c double, d double, f double, g double, quality string, loo_median double"),
        "plat_entry": rows([(f"1-{m}", 1, i, "B", str(100 + i), i / 3, -i / 7) for m in (0, 1) for i in range(11)], "map_id string, cem_id bigint, ord bigint, block string, lot string, x double, y double"),
        "ground_vertex": rows([(1, p, v, 43 + v / 1000, -84 - p / 1000) for p in (0, 1) for v in range(4 + p)], "cem_id bigint, poly int, v int, lat double, lng double"),
        "drive_vertex": rows([(1, 0, v, 43 + v / 900, -84.0) for v in range(3)], "cem_id bigint, poly int, v int, lat double, lng double"),
        "gate": rows([(1, 0, 43.01, -84.02)], "cem_id bigint, gate int, lat double, lng double"),
        "request": rows([(1, i, 500 + i, 900 + i, "Ann", "Lee", None, 1900, None, "Lot é " + str(i), None, None, None, "2024-01-01", 43.0 + i, None, "", None) for i in range(9)],
                        "cem_id bigint, ord bigint, prid bigint, mid bigint, fn string, ln string, name string, by int, dy int, plot string, bd string, dd string, notes string, created string, lat double, lng double, claimed string, problem string"),
        "memorial": rows([(1, 10 * i, 100 + i, f"Name {i}", "", 1800 + i, 0, "", 43.0 if i % 2 else None, -84.0 if i % 2 else None, i, "A|B") for i in range(25)],
                         "cem_id bigint, ord bigint, mid bigint, name string, maiden string, by int, dy int, plot string, lat double, lng double, flags int, fam string"),
        "register": rows([(1, i, i, "LEE, ANN", "F", "", "1", "", "Old", "", "A", "1", "2", "", 4, "note | with \"marks\"", "") for i in range(7)],
                         "cem_id bigint, ord bigint, " + ", ".join(f"{c} {'bigint' if c == 'key' else 'int' if c == 'flags' else 'string'}" for c in feeds.REGISTER_POS)),
    }


def plain(df, name, sent):
    cols = [c for c in sent.columns if c != "ord"]
    return sorted(map(str, (tuple(r[c] for c in cols) for r in df.select(*cols).collect())))


@pytest.mark.parametrize("page_rows", [1, 4, 1000])
def test_round_trip(spark, tmp_path, page_rows):
    sent = tables(spark)
    path = str(tmp_path / "bundle")
    publish.write_bundle(publish.publish_bundle(sent, "2024-06-01", (43.4, -84.6), 60, page_rows), path)
    got = feeds.read_bundle(spark, path, one_per_line=True)
    for name, df in sent.items():
        assert plain(got[name], name, df) == plain(df, name, df), name
        if "ord" in df.columns and name != "plat_entry":  # places are dense and in the order sent
            assert [r[ORDERED[name]] for r in got[name].orderBy("ord").collect()] == [r[ORDERED[name]] for r in df.orderBy("ord").collect()]
            assert sorted(r["ord"] for r in got[name].collect()) == list(range(df.count()))
    assert publish.bundle_gaps(got).count() == 0
    told = {(r["cem_id"], r["kind"]): (r["n"], r["pages"]) for r in got["manifest"].collect()}
    assert told == {(1, k): (n, -(-n // page_rows)) for k, n in (("requests", 9), ("memorials", 25), ("roster", 7))} | {(1, "entries"): (22, 2 * -(-11 // page_rows))}
    lines = [json.loads(r[0]) for r in spark.read.text(path).select("value").collect()]
    assert all(d["v"] == 2 and len(d["cemeteries"]) == 1 and max(len(d["cemeteries"][0].get(k, [])) for k in ("requests", "memorials", "roster")) <= page_rows for d in lines)


def test_a_lost_page_is_noticed_and_other_cemeteries_stay(spark, tmp_path):
    sent, path = tables(spark), str(tmp_path / "bundle")
    docs = publish.publish_bundle(sent, page_rows=4)
    publish.write_bundle(docs.filter("NOT (kind = 'memorials' AND page = 2)"), path)
    gaps = publish.bundle_gaps(feeds.read_bundle(spark, path, one_per_line=True)).collect()
    assert [(r["cem_id"], r["kind"], r["n"], r["found"]) for r in gaps] == [(1, "memorials", 25, 21)]
    publish.write_bundle(docs.filter("cem_id = 1"), path)
    got = feeds.read_bundle(spark, path, one_per_line=True)
    assert publish.bundle_gaps(got).count() == 0 and got["cemetery"].count() == 2


def test_texts_are_parsed_once_for_all_tables(spark, tmp_path):
    path = str(tmp_path / "bundle")
    publish.write_bundle(publish.publish_bundle(tables(spark), page_rows=4), path)
    got = feeds.read_bundle(spark, path, one_per_line=True)
    assert all("json" not in df._jdf.queryExecution().executedPlan().toString().lower() for df in got.values())
