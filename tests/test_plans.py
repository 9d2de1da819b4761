"""Plans that the driver can hold: what is read many times is written once, what is exploded is not broadcast."""

from plotlink.catalog import fixtures, maps, registry
from plotlink.catalog.registry import Tables, model
from plotlink.functions.lineage import written
from plotlink.operators import anchors, burials, georef, linkage, maintain
from plotlink.plans import locate

SF = "/root/testdata/sf0.001"


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_claims_plan_few_joins_at_once(spark, monkeypatch):
    m, seen = model(Tables(spark, SF)), []
    for name in ("checkpointed", "written"):
        monkeypatch.setattr(linkage, name, lambda df, *a, f=getattr(linkage, name): seen.append(joins(df)) or f(df, *a))
    linkage.era_gated_link(m.register, m.memorial, m.links, m.cemetery).count()
    assert seen and max(seen) <= 10, seen


def test_evidence_keys_are_not_broadcast(spark):
    m = model(Tables(spark, SF))
    fold = lambda df, side, key: written(linkage.profiles(df, side, key), "profiles")
    pairs = linkage.scored_profiles(fold(m.register, "r", "key"), fold(m.memorial, "m", "mid"), "r", "m", 55)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_leave_one_out_goes_over_the_pairs_twice(spark):
    rows = [(1, i, float(i % 7), float(i * i % 11), 2.0 * (i % 7) + i % 3, 3.0 * (i * i % 11)) for i in range(40)]
    pairs = spark.createDataFrame(rows, "map_id int, ord long, x double, y double, e double, n double").selectExpr("*", "1d AS w")
    got = georef.leave_one_out(pairs)
    assert joins(got) == 1 and got.columns == ["map_id", "median", "p75", "p90", "n_loo"]
    (row,) = got.collect()
    assert row.n_loo == 40 and 0 < row.median <= row.p75 <= row.p90


def test_consensus_reads_its_steps_once(spark):
    rows = [(1, i, float(i % 7), float(i * i % 11), 2.0 * (i % 7) + i % 3, 3.0 * (i * i % 11)) for i in range(40)]
    pairs = spark.createDataFrame(rows, "map_id int, ord long, x double, y double, e double, n double").selectExpr("*", "1d AS w")
    assert joins(georef.ransac_affine(pairs, area=1)) <= 6


def test_photo_slots_read_their_states_once(spark):
    stored = spark.createDataFrame([("a", 0, "h1")], "pk string, slot int, sha string")
    come = spark.createDataFrame([(1, "a", 0, "h1", 9, "FFD8"), (2, "a", 0, "h2", 9, "FFD8"), (3, "b", 1, "h3", 9, "FFD8"), (4, "b", 1, "h3", 9, "FFD8")],
                                 "arrival long, pk string, slot int, sha string, size long, magic string")
    got = maintain.assign_photo_slots(stored, come)
    assert joins(got) <= 3
    assert {tuple(r) for r in got.collect()} == {(1, "a", 0, "retry"), (2, "a", 1, "moved"), (3, "b", 1, "as asked"), (4, "b", 1, "retry")}


PARTS = "cem_id int, section string, sub string, block string, lot string"


def test_tiers_and_sections_are_planned_one_at_a_time(spark):
    rows = [(1, "A", "", "1", str(i % 4), 10.0 + i % 4, 20.0, "field", i) for i in range(12)]
    anchor = spark.createDataFrame(rows, "cem_id int, section string, sub string, block string, lot_key string, e double, n double, src string, ord long")
    cem = spark.createDataFrame([(1, 43.0, -84.0)], "cem_id int, lat double, lng double")
    given = spark.createDataFrame([], "cem_id int, section string, lat double, lng double, radius int")
    plat = spark.createDataFrame([], "cem_id int, map_ord int, section string, sub string, style string, quality string, loo_median double, ord long, block string, lot string, e double, n double")
    section = anchors.derive_sections(anchor, given, cem)
    assert joins(section) <= 4 and section.count() == 1
    got = locate.locate_plots(spark.createDataFrame([(1, "A", "", "1", "2"), (1, "A", "", "9", "")], PARTS), plat, anchor, section, cem)
    assert joins(got) <= 1
    assert {(r.block, r.level) for r in got.collect()} == {("1", "lot"), ("9", "section")}


def test_neighbours_are_found_once_and_then_ranked(spark):
    people = [(1, "mem", i, i, f"N{i}", 0, 0, "A", "", "1", "5", str(i), i % 2 == 0, False, "5", 5, "", "1") for i in range(4)]
    b = spark.createDataFrame(people, "cem_id int, kind string, id long, ord long, name string, by int, dy int, section string, sub string, block string, lot string, "
                              "grave string, has_photo boolean, hidden boolean, lot_key string, lot_n int, group_sub string, group_block string")
    got = burials.neighbor_pick(spark.createDataFrame([(2, 1, "A", "", "1", "5")], f"mid long, {PARTS}"), b)
    assert joins(got) <= 1
    assert sorted(r.id for r in got.collect()) == [0, 1, 3]


def test_a_reverse_link_builds_no_requests(spark, monkeypatch):
    made = registry.Tables(spark, SF)
    monkeypatch.setattr(registry, "_MODELS", {})
    registry.QUERIES["best_register_per_memorial"](spark, SF).count()
    assert "request" not in registry.model(made)._made


def test_base_tables_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 40)
    monkeypatch.setattr(fixtures, "_PARTS", {})
    rows = spark.read.parquet(f"{SF}/part.parquet").count()
    dealt = spark.sql(fixtures._base(spark, SF, "part"))
    assert dealt.count() == rows and dealt.rdd.getNumPartitions() >= max(rows / 40, spark.sparkContext.defaultParallelism)


def test_a_fit_does_not_lay_out_its_pairs(spark):
    label = spark.createDataFrame([(m, 1, "A", "lots" if m == 9 else "rows", b, str(i), float(i % 4), float(i * i % 7)) for m in (1, 2, 9) for i in range(12) for b in ("P", "Q")][:60],
                                  "map_id int, cem_id int, section string, style string, block string, lot string, x double, y double")
    pins = spark.createDataFrame([(1, "A", "", b, i, i % 4 * 2.0 + j % 3, i * i % 7 * 3.0 + j % 2, 1 / (1 + j % 4), 100 * i + j) for i in range(12) for j in range(9) for b in ("P", None)],
                                 "cem_id int, section string, sub string, block string, lot_n long, e double, n double, w double, ord long")
    rounded = lambda df: sorted((r.map_id, r.n_pairs, *[round(r[k], 8) for k in georef.T6]) for r in df.collect())
    got = georef.fit_anchors(label, pins)
    assert rounded(got) == rounded(georef.fit_affine(georef.map_anchor_pairs(label, pins))) and got.count() >= 2
    # pins of one lot are summed before they meet labels
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [cem_id") >= 1 and "sum(w" in plan[plan.index("Join"):]


def test_pins_are_weighed_without_names(spark, monkeypatch):
    monkeypatch.setattr(registry, "_MODELS", {})
    t = registry.Tables(spark, SF)
    maps._pins(t).count()
    m = registry.model(t)
    assert "memorial" not in m._made
    cols = ["cem_id", "ord", "lat", "lng", "section", "sub", "block", "lot", "grave"]
    assert sorted(map(str, m.pinned.select(cols).collect())) == sorted(map(str, m.memorial.filter("lat IS NOT NULL").select(cols).collect()))


def test_a_query_plans_only_the_inputs_it_reads(spark, monkeypatch):
    from plotlink.catalog.all import QUERIES

    monkeypatch.setattr(registry, "_MODELS", {})
    monkeypatch.setattr(fixtures, "_PARTS", {})
    for slug in ("burial_union", "person_by_pk"):
        assert QUERIES[slug](spark, SF).count() > 0
        assert set(registry.model(registry.Tables(spark, SF)).raw) == {"cemetery", "memorial", "register", "pin"}
        assert {p.rsplit("/", 1)[1] for p in fixtures._PARTS} == {"orders.parquet", "events.parquet"}


def test_a_written_table_is_opened_without_a_job(spark):
    sc, df = spark.sparkContext, spark.range(9).selectExpr("id", "named_struct('a', id, 'b', array(cast(id AS string))) AS s")
    sc.setJobGroup("written", "")
    try:
        got = written(df, "opened")
        # the write is the only job
        assert len(sc.statusTracker().getJobIdsForGroup("written")) == 1
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got.collect()) == sorted(df.collect()) and got.dtypes == df.dtypes


def test_spread_plots_are_not_broadcast(spark):
    p = locate.distinct_plots(spark.createDataFrame([(1, "A", "", "1", str(i)) for i in (3, 9)], PARTS))
    entry = [(1, 1, "A", "", "blocks", "good", 4.0, i, "1", str(i), 10.0 * i, 5.0) for i in (1, 2, 4)]
    plat = spark.createDataFrame(entry, "cem_id int, map_ord int, section string, sub string, style string, quality string, loo_median double, ord long, block string, lot string, e double, n double")
    clusters = spark.createDataFrame([(1, "A", "", "1", "2", 20.0, 5.0, 1), (1, "A", "", "1", "4", 40.0, 5.0, 2)], "cem_id int, section string, sub string, block string, lot_key string, e double, n double, pins long")
    p, clusters, entries = written(p, "plots"), written(clusters, "lot-clusters"), written(locate._keyed_entries(plat), "plat-entries")
    drawn, pinned = locate.plat_adjacent(p, entries), locate.anchor_adjacent(p, clusters)
    for tier in (drawn, pinned):
        assert "SortMergeJoin" in tier._jdf.queryExecution().executedPlan().toString()
    assert [(r.lot, round(r.e, 6)) for r in drawn.collect()] == [("3", round((40 / 2 + 20 / 2 + 10 / 3) / (1 / 2 + 1 / 2 + 1 / 3), 6))]
    assert [(r.lot, round(r.e, 6), r.pins) for r in pinned.collect()] == [("3", 30.0, 3)]
