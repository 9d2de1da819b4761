"""Rule-by-rule cases on small literal tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plotlink.functions import names, plots
from plotlink.operators import anchors, burials, family, georef, linkage, maintain, report
from plotlink.operators import standardize as std
from plotlink.plans import locate
from plotlink.sources import feeds, registers
from plotlink.streaming import progress as pg

PARTS = plots.PARTS


def plot_of(spark, text, aliased=False):
    df = spark.createDataFrame([(text,)], "plot string")
    row = (plots.parse_aliased if aliased else plots.parse_generic)(df, "plot").first()
    return None if row["section"] is None else tuple(row[p] for p in PARTS)


@pytest.mark.parametrize("text,want", [
    ("Section 4, Lot 12, Grave 2", ("Section 4", "", "", "12", "2")),
    ("sec b Blk 007 lot 9A space 3", ("Section B", "", "7", "9", "3")),
    ("East Annex Lot 31/32", ("East Annex", "", "", "31", "")),
    ("Plot 8", ("*", "", "", "", "8")),
    ("Grave 2 Plot 8", ("*", "", "", "8", "2")),
    ("ID 20417 Lot 5", ("*", "", "", "5", "")),
    ("Hilltop-3rd ADD-40--1", ("3rd ADD", "", "", "40", "1")),
    ("Hilltop-K-12-N 1/2-4", ("K", "", "", "12", "4")),
    ("CEM-7-C-014-2", ("7", "", "C", "14", "2")),
    ("14c", ("*", "", "", "14", "C")),
    ("QQ", ("*", "", "QQ", "", "")),
    ("0", ("*", "", "", "0", "")),
    ("Lakeside Rise", ("Lakeside Rise", "", "", "", "")),
    ("no location on file", None),
    ("unknown", None),
    ("", None),
])
def test_plot_text(spark, text, want):
    assert plot_of(spark, text) == want


@pytest.mark.parametrize("text,want", [
    ("Sqare Hil Blk 0B Lot 7", ("Square Hill", "", "", "7", "")),
    ("Old Part 3 Lot 5 Grave 1", ("Old Part", "3", "", "5", "1")),
    ("Old Part Block 4 Lot 2", ("Old Part", "4", "", "2", "")),
    ("Section 7 Row C Lot 11", ("Oak Hill", "", "C", "11", "")),
    ("Some Other Place", None),
])
def test_aliased_plot_text(spark, text, want):
    assert plot_of(spark, text, aliased=True) == want


def test_codes(spark):
    df = spark.createDataFrame([("OAKGROVE-011-B-051-3",), ("OAKGROVE-25-158-4-",), ("LAKE-007-C-0-",), ("nothing",)], "code string")
    rows = {r["code"]: tuple(r[p] for p in PARTS) for r in plots.decode_code(df, "code").collect()}
    assert rows["OAKGROVE-011-B-051-3"] == ("Square Hill", "", "B", "51", "3")
    assert rows["OAKGROVE-25-158-4-"] == ("", "", "158", "4", "")
    assert rows["LAKE-007-C-0-"] == ("Section 7", "", "C", "0", "")
    assert rows["nothing"][0] is None


def test_lot_keys(spark):
    df = spark.createDataFrame([("12A",), ("0",), ("CC",), ("",), ("007",)], "lot string")
    got = {r["lot"]: r["k"] for r in df.select("lot", plots.lot_key(F.col("lot")).alias("k")).collect()}
    assert got == {"12A": "12", "0": "0", "CC": "CC", "": "", "007": "7"}


def test_names(spark):
    df = spark.createDataFrame([("DOE, Bob (Smith?)",), ("Mary Ann O'Brien Jr.",), ("Cher",), ("Van Buren III, Wm",), ("",)], "name string")
    got = {r["name"]: (r["nl"], r["cf"], r["fr"], r["sx"]) for r in names.name_keys(df, "name").collect()}
    assert got["DOE, Bob (Smith?)"] == ("doe", "robert", "bob", "D000")
    assert got["Mary Ann O'Brien Jr."] == ("obrien", "mary", "mary", "O165")
    assert got["Cher"] == ("cher", "", "", "C600")
    assert got["Van Buren III, Wm"] == ("van buren", "william", "wm", "V516")
    assert got[""] == ("", "", "", "")


MEM = "cem_id int, ord long, mid long, name string, maiden string, by int, dy int, plot string, lat double, lng double, flags int, fam string"
REG = ("cem_id int, ord long, key long, name string, sex string, bd string, dd string, burial string, section string, sub string, block string, "
       "lot string, grave string, status string, flags int, note string, former string")


def mems(spark, rows):
    return std.memorial_table(spark.createDataFrame([(1, i, i + 1, *r) for i, r in enumerate(rows)], MEM))


def regs(spark, rows):
    return std.register_table(spark.createDataFrame(
        [(1, i, i + 1, n, "", b, d, "", s, "", bl, lo, "", "", 0, "", "") for i, (n, b, d, s, bl, lo) in enumerate(rows)], REG))


def test_spouse_is_not_a_link(spark):
    m = mems(spark, [("Harold Finch", "", 1880, 1950, "Section A Blk 2 Lot 5", None, None, 0, "")])
    r = regs(spark, [("FINCH, EDITH", "1881", "1951", "Section A", "2", "5"), ("FINCH, HAL", "1880", "1950", "Section A", "2", "5")])
    got = [(x["key"], x["status"]) for x in linkage.link_register_memorial(r, m).collect()]
    assert got == [(2, "link")]


def test_equal_bests_never_link(spark):
    twin = ("John Finch", "", 1880, 1950, "", None, None, 0, "")
    m = mems(spark, [twin, twin])
    got = linkage.link_register_memorial(regs(spark, [("FINCH, JOHN", "1880", "1950", "", "", "")]), m).collect()
    assert [(x["status"], x["score"], x["second"], x["mid"]) for x in got] == [("maybe", 110, 110, 1)]


def test_link_equals_all_pairs(spark):
    rng = random.Random(7)
    last, first = ["finch", "fynch", "moss", "mosse", ""], ["john", "jon", "jonathan", "j", "mary", "polly", "", "johan"]
    year = lambda: rng.choice([0, 1880, 1881, 1883, 1890])
    plot = lambda: rng.choice(["", "Section A Blk B Lot 4", "Section A Blk B Lot 5", "Section C Blk B Lot 4"])
    m = mems(spark, [(f"{rng.choice(first)} {rng.choice(last)}", rng.choice(["", "", "moss"]), year(), year(), plot(), None, None, 0, "") for _ in range(60)])
    r = regs(spark, [(f"{rng.choice(last)}, {rng.choice(first)}", str(year()), str(year()), rng.choice(["Section A", "Section C", ""]), "B", rng.choice(["4", "5", "05"]))
                     for _ in range(60)])
    a = linkage.profiles(r, "r", "key")
    b = linkage.profiles(m, "m", "mid")
    brute = a.join(b, "cem_id").withColumn("score", linkage.score("r", "m")).filter("score >= 55")
    brute = brute.filter("r_nl = m_nl OR r_nl = m_nm OR r_sx = m_sx OR (r_nm <> '' AND r_nm = m_nl)")
    key = lambda df: sorted(tuple(x) for x in df.select("r_ord", "m_ord", "r_n", "m_n", "score").collect())
    assert key(linkage.score_pairs(r, m)) == key(brute)


def test_claims_in_order(spark):
    rng = random.Random(3)
    rows = [(1, i, i, rng.sample(range(8), rng.randint(1, 3))) for i in range(20)]
    cand = spark.createDataFrame([(c, k, o, m) for c, k, o, ms in rows for m in ms], "cem_id int, key long, ord long, mid long")
    taken, want = set(), set()
    for _, k, _, ms in rows:
        free = [m for m in ms if m not in taken]
        if len(free) == 1:
            taken.add(free[0])
            want.add((k, free[0]))
    assert {(r["key"], r["mid"]) for r in linkage.claim_in_order(cand).collect()} == want


def test_clusters_are_components(spark):
    rng = random.Random(5)
    pts = [(1, str(rng.randint(1, 50)), round(rng.uniform(0, 120), 1), round(rng.uniform(0, 120), 1)) for _ in range(220)]
    parent = list(range(len(pts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(pts)), 2):
        if ((pts[i][2] - pts[j][2]) ** 2 + (pts[i][3] - pts[j][3]) ** 2) ** 0.5 < 10:
            parent[find(i)] = find(j)
    want = {}
    for i in range(len(pts)):
        want.setdefault(find(i), []).append(i)
    df = spark.createDataFrame(pts, "map_id long, s string, x double, y double")
    got = georef.cluster_labels(df).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == sorted(len(v) for v in want.values() if len(v) >= 5)


def test_transcript_survives_chunking(spark, monkeypatch):
    lines = ["SECTION one", "Row one", "Fox, Amy  1900 - 1950", "Fox, Bob  1950", "Row two", "Gray, Al", "SECTION two", "Hale, Cy  1901", "Row one", "Ives, Di  1902 - 1960 (urn)"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line long, text string")
    keep = lambda d: sorted(tuple(r) for r in d.select("line", "name", "section", "block", "lot", "bd", "dd", "note").collect())
    whole = keep(registers.walk_order_transcript(df))
    monkeypatch.setattr(registers, "CHUNK", 2)
    assert keep(registers.walk_order_transcript(df)) == whole
    assert whole == [(2, "FOX, AMY", "Section 1", "1", "1", "1900", "1950", ""), (3, "FOX, BOB", "Section 1", "1", "2", "", "1950", ""),
                     (5, "GRAY, AL", "Section 1", "2", "1", "", "", ""), (9, "IVES, DI", "Section 2", "1", "1", "1902", "1960", "urn")]


def cem(spark):
    return spark.createDataFrame([(1, 43.0, -84.0)], "cem_id int, lat double, lng double")


def at(e, n):
    import math
    m = math.pi / 180 * 6371000
    return 43.0 + n / m, -84.0 + e / (m * math.cos(math.radians(43.0)))


def test_anchor_only_cemetery(spark):
    spots = [("Section A Blk 1 Lot 5", 10, 20), ("Section A Blk 1 Lot 5", 12, 21), ("Section A Blk 1 Lot 5", 300, 300), ("Section A Blk 1 Lot 6", 14, 24)]
    m = mems(spark, [(f"A B{i}", "", 0, 0, p, *at(e, n), 0, "") for i, (p, e, n) in enumerate(spots)])
    none = regs(spark, [("X, Y", "", "", "", "", "")]).join(spark.createDataFrame([(-1, 0.0, 0.0)], "key long, lat double, lng double"), "key")
    a = anchors.gps_anchors(m, none, cem(spark))
    lot5 = anchors.anchor_clusters(a).filter("lot_key = '5'").first()
    assert (round(lot5["e"]), round(lot5["n"]), lot5["pins"], lot5["n_all"]) == (12, 21, 2, 3)
    plat = spark.createDataFrame([], "cem_id int, map_ord int, section string, sub string, style string, quality string, loo_median double, ord long, block string, lot string, e double, n double")
    given = spark.createDataFrame([], "cem_id int, section string, lat double, lng double, radius int")
    sec = anchors.derive_sections(a, given, cem(spark))
    want = spark.createDataFrame([(1, "Section A", "", "1", l) for l in ("5", "8", "20", "")] + [(1, "Section A", "", "9", "1"), (1, "Section Z", "", "1", "1")],
                                 "cem_id int, section string, sub string, block string, lot string")
    got = {(r["section"], r["block"], r["lot"]): (r["level"], r["acc"]) for r in locate.locate_plots(want, plat, a, sec, cem(spark)).collect()}
    assert got[("Section A", "1", "5")] == ("lot", 7)
    assert got[("Section A", "1", "8")] == ("adjacent", 14)
    assert got[("Section A", "1", "20")][0] == "block"
    assert got[("Section A", "1", "")][0] == "block"
    assert got[("Section A", "9", "1")][0] == "section"
    assert ("Section Z", "1", "1") not in got


def test_walk_row_fit_and_refusal(spark):
    def fit(step):
        m = mems(spark, [(f"A P{i}", "", 0, 0, "", *at(10 + step * i, 50), 0, "") for i in (2, 8)])
        r = regs(spark, [(f"P{i}, A", "", "", "Section 1", "1", str(i)) for i in range(1, 11)])
        linked = spark.createDataFrame([(1, 2, 1), (1, 8, 2)], "cem_id int, key long, mid long")
        pins = r.join(spark.createDataFrame([(-1, 0.0, 0.0)], "key long, lat double, lng double"), "key")
        plat = spark.createDataFrame([], "cem_id int, section string, block string, lot string")
        return {x["lot"]: x["e"] for x in anchors.fit_walk_rows(r, linked, m, pins, plat, cem(spark)).collect()}

    got = fit(2)
    assert abs(got["5"] - 20) < 0.05 and len(got) == 10
    assert fit(89) == {}


def test_shuffled_streams_merge_alike(spark, tmp_path):
    rows = [(i, str(i % 7), (i * 13) % 5, "s%d" % i, None, False, False, False) for i in range(60)]
    schema = "arrival long, pk string, ts long, st string, note string, tombstone boolean, photo boolean, up boolean"
    batch = sorted(tuple(r) for r in pg.merge_progress(spark.createDataFrame(rows, schema)).collect())
    random.Random(1).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = pg.run_merge_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(tuple(r) for r in got.collect()) == batch


def test_photo_slots(spark):
    stored = spark.createDataFrame([("1", 0, "a")], "pk string, slot int, sha string")
    inc = spark.createDataFrame([(1, "1", 0, "a", 5, "ffd8"), (2, "1", 0, "b", 5, "FFD8"), (3, "1", 0, "c", 5, "ffd8"), (4, "1", 1, "d", 5, "ffd8"), (5, "1", 2, "e", 0, "ffd8")],
                                "arrival int, pk string, slot int, sha string, size int, magic string")
    got = {r["arrival"]: (r["slot"], r["result"]) for r in maintain.assign_photo_slots(stored, inc).collect()}
    assert got == {1: (0, "retry"), 2: (2, "moved"), 3: (3, "moved"), 4: (1, "as asked"), 5: (None, "empty")}


def test_sheets_need_their_columns(spark):
    with pytest.raises(ValueError):
        feeds.import_requests_sheet(spark.createDataFrame([("x",)], "foo string"))
    with pytest.raises(ValueError):
        feeds.import_register_sheet(spark.createDataFrame([("x",)], "section string"))


def test_legacy_bundle(spark, tmp_path):
    doc = ('{"meta":{"cemetery":"Old","fagCemeteryId":9,"cem":{"lat":43.0,"lng":-84.0},"asOf":"2020-01-01"},'
           '"memorials":[[5,"Ann Lee","",1900,"1950","Lot 1",null,null,3,"Bo Lee|Cy Lee"],[null,"x"],[5,"Ann B Lee","",1900,1950,"",43.1,-84.1,1,""]],"roster":[["7","LEE, ANN"]],"requests":[{"mid":5,"fn":"Ann"}]}')
    (tmp_path / "d.json").write_text(doc)
    b = feeds.read_bundle(spark, str(tmp_path / "d.json"))
    c = b["cemetery"].first()
    assert (c["cem_id"], c["name"], c["as_of"], c["declination"]) == (9, "Old", "2020-01-01", -6.6)
    m = b["memorial"].collect()
    assert [(r["mid"], r["ord"], r["name"], r["lat"]) for r in m] == [(5, 0, "Ann B Lee", 43.1)]
    assert b["register"].first()["key"] == 7 and b["request"].count() == 1


def test_natural_sort(spark):
    df = spark.createDataFrame([("Section 10",), ("Section 2",), ("section 1b",), ("A 3",)], "s string")
    got = [r["s"] for r in df.orderBy(report.natural_key(F.col("s"))).collect()]
    assert got == ["A 3", "section 1b", "Section 2", "Section 10"]


def test_text_lots_are_neighbours_only_when_equal(spark):
    m = mems(spark, [("A One", "", 0, 0, "Section A Lot CC", None, None, 1, ""), ("B Two", "", 0, 0, "Section A Lot DD", None, None, 0, ""), ("C Three", "", 0, 0, "Section A Lot CC", None, None, 0, "")])
    none = spark.createDataFrame([], "cem_id int, key long, mid long")
    b = burials.burial_union(m, regs(spark, [("X, Y", "", "", "", "", "")]), none)
    t = m.filter("mid = 1").select("mid", "cem_id", "section", "sub", "block", "lot")
    assert [r["id"] for r in burials.neighbor_pick(t, b).collect()] == [3]


def test_similarity_recovers_a_known_page(spark):
    import math
    rot, sc = math.radians(5), 0.5
    clusters, dom, cent = [], [], []
    for b in range(7):
        bx, by = 60.0 * (b % 3), 55.0 * (b // 3) + 13.0 * b
        for i in range(6):
            clusters.append((1, b, str(10 * b + i), 10 * b + i, bx + i, by, 6, 10 * b + 5, bx + 2.5, by))
            dom.append((1, f"B{b}", 10 * b + i))
        cent.append((1, f"B{b}", sc * (math.cos(rot) * (bx + 2.5) - math.sin(rot) * by) + 7, sc * (math.sin(rot) * (bx + 2.5) + math.cos(rot) * by) - 3))
    got = georef.similarity_consensus(
        spark.createDataFrame(clusters, "map_id long, cluster long, s string, num long, x double, y double, size long, max_num long, cx double, cy double"),
        spark.createDataFrame(dom, "map_id long, block string, num long"), spark.createDataFrame(cent, "map_id long, block string, e double, n double"), min_cluster=5).first()
    assert got["n_blocks"] == 7 and abs(got["a"] - sc * math.cos(rot)) < 1e-6 and abs(got["c"] - 7) < 1e-6 and abs(got["g"] + 3) < 1e-6


def test_family_links_ignore_oneself(spark):
    m = mems(spark, [("Ann Lee", "", 0, 0, "", None, None, 0, "Ann Lee|Bo Lee"), ("Bo Lee", "", 0, 0, "", None, None, 0, "")])
    got = sorted((r["mid"], r["kin"], r["n_kin"], r["first_kin"], r["direction"]) for r in family.family_links(m).collect())
    assert got == [(1, "bo lee", 1, 2, "lists"), (2, "bo lee", 1, 1, "listed_by")]


def test_pages_of_any_size_keep_their_ordinals_apart(spark):
    long = "[" + ",".join(f'[{i + 1},"A B"]' for i in range(100_050)) + "]"
    df = spark.createDataFrame([(1, 0, long), (1, 1, '[[900001,"C D"],[900002,"E F"]]')], "cem_id int, page int, rows string")
    out = feeds.read_memorial_rows(df)
    assert out.count() == out.select("ord").distinct().count() == 100_052
    assert [r["mid"] for r in out.orderBy(F.desc("ord")).limit(2).collect()] == [900002, 900001]


def test_consensus_draws_from_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        x, y = rng.uniform(0, 900), rng.uniform(0, 900)
        good = i >= 70  # the true pairs come last, where a prefix would not reach
        e, n = (0.5 * x - 0.1 * y + 7, 0.1 * x + 0.6 * y - 3) if good else (rng.uniform(-500, 500), rng.uniform(-500, 500))
        rows.append((1, i, x, y, e, n, 1.0))
    fit = georef.ransac_affine(spark.createDataFrame(rows, "map_id long, ord long, x double, y double, e double, n double, w double")).first()
    assert [round(fit[c], 3) for c in "abcdfg"] == [0.5, -0.1, 7.0, 0.1, 0.6, -3.0] and fit["used"] >= 50


def test_a_cell_has_one_vote(spark):
    rows = []
    for i in range(8):  # eight cells on a unit grid, each with its true place
        x, y = float(i % 4), float(i // 4)
        rows.append((1, f"c{i}", x, y, 4 * x + 1, 4 * y + 2))
    pairs = spark.createDataFrame(rows, "map_id long, cell string, x double, y double, e double, n double").withColumns({"ord": F.xxhash64("cell"), "w": F.lit(1.0)})
    five = pairs.filter("cell < 'c5'").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("_k")  # 15 pairs, but five cells
    find = lambda p: georef.ransac_affine(p, inlier_m=1, area=1e-6, vote="ord", least=6, scales=(0.5, 25)).collect()
    assert find(five) == []
    assert round(find(pairs)[0]["a"], 6) == 4.0


def test_missing_keys_in_runs(spark):
    cached = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 4, False), (1, 6, True), (2, 3, True)], "register int, key long, miss boolean")
    bounds = spark.createDataFrame([(1, 7), (2, 3)], "register int, max_key long")
    got = sorted((r["register"], r["key"]) for r in maintain.missing_keys(cached, bounds, 2).collect())
    assert got == [(1, 3), (1, 5), (1, 6), (1, 7), (2, 1), (2, 2), (2, 3)]


def test_typed_text_is_normalised_before_its_length_counts(spark):
    mem = spark.createDataFrame([(1, 7, 0, "Mary O'Ster", "mary oster"), (1, 8, 1, "Jay Moss", "jay moss")], "cem_id int, mid long, ord long, name string, sk string")
    none = spark.createDataFrame([], "cem_id int, key long, ord long, name string, sk string")
    got = {(r["query"], r["id"]) for r in report.search_burials(mem, none, none.select("cem_id", "key"), ["O'STER", " mary  O", "J.", "moss"]).collect()}
    assert got == {("O'STER", 7), ("moss", 8), (" mary  O", 7)}


def test_a_page_of_many_seeds_is_placed_by_its_few_true_ones(spark):
    rng = random.Random(1)
    true, clusters, dom, cent = (0, 1, 2, 3, 9), [], [], []
    for b in range(12):
        e, n = rng.uniform(0, 9000), rng.uniform(0, 9000)
        bx, by = (2 * e - 100, 2 * n + 60) if b in true else (rng.uniform(0, 18000), rng.uniform(0, 18000))
        clusters += [(1, b, str(i), i, bx, by, 6, 5, bx, by) for i in range(6)]
        dom += [(1, f"B{b:02d}", i) for i in range(6)]
        cent.append((1, f"B{b:02d}", e, n))
    got = georef.similarity_consensus(
        spark.createDataFrame(clusters, "map_id long, cluster long, s string, num long, x double, y double, size long, max_num long, cx double, cy double"),
        spark.createDataFrame(dom, "map_id long, block string, num long"), spark.createDataFrame(cent, "map_id long, block string, e double, n double"), min_cluster=5).collect()
    assert len(got) == 1 and got[0]["n_blocks"] >= 5 and abs(got[0]["a"] - 0.5) < 1e-6 and abs(got[0]["c"] - 50) < 1e-3 and abs(got[0]["g"] + 30) < 1e-3


def test_groups_of_up_to_26_pairs_are_searched_exhaustively(spark):
    rng = random.Random(5)
    rows = []
    for i in range(26):  # four true pairs, of which no draw holds three
        x, y = rng.uniform(0, 900), rng.uniform(0, 900)
        e, n = (0.5 * x - 0.1 * y + 7, 0.1 * x + 0.6 * y - 3) if i + 1 in (1, 4, 12, 20) else (rng.uniform(-50_000, 50_000), rng.uniform(-50_000, 50_000))
        rows.append((1, i, x, y, e, n, 1.0))
    fits = georef.ransac_affine(spark.createDataFrame(rows, "map_id long, ord long, x double, y double, e double, n double, w double")).collect()
    assert [[round(f[c], 3) for c in "abcdfg"] for f in fits] == [[0.5, -0.1, 7.0, 0.1, 0.6, -3.0]] and fits[0]["used"] == 4


def test_register_pages_keep_their_own_labels(spark):
    row = lambda label, value: f'<div class="label-value-row-label">{label}</div><div role="cell" class="label-value-row-value">{value}</div>'
    html = row("Name", "LEE, ANN &amp; BO") + row("Parcel Owner", "someone") + row(" Sex ", "Sex") + row("Name", "LATER") + row("", "x")
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = lambda **o: {r["label"]: r["value"] for r in registers.extract_label_values(pages, "page_id", "html", **o).collect()}
    assert got() == {"Name": "LEE, ANN & BO", "Sex": ""}
    assert got(keep=None) == {"Name": "LEE, ANN & BO", "Sex": "", "Parcel Owner": "someone"}
