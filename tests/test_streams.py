"""Streams of several batches: state is folded, replays change nothing, reading is bound by live keys."""

import random

from plotlink.streaming import progress as pg

SCHEMA = "arrival long, pk string, ts long, st string, note string, tombstone boolean, photo boolean, up boolean"


def changes(n=120, keys=9, seed=1):
    rng = random.Random(seed)
    return [(i, str(rng.randrange(keys)), rng.randrange(12), f"s{i}", None, i % 10 == 0, False, True) for i in range(n)]


def feed(spark, rows, path, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_folded_state_equals_the_batch_and_goes_on_after_a_stop(spark, tmp_path):
    rows = changes()
    out, ck, src = (str(tmp_path / x) for x in ("out", "ck", "in"))
    got = pg.run_merge_stream(feed(spark, rows[:70], src, 7), out, ck, fold_every=3)
    want = lambda rs: sorted(map(str, (tuple(r) for r in pg.merge_progress(spark.createDataFrame(rs, SCHEMA)).collect())))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == want(rows[:70])
    again = pg.run_merge_stream(feed(spark, rows[70:], src, 5), out, ck, fold_every=3)  # the same stream, later
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == want(rows)
    # twelve batches: four folds; the state is read from the last one and an open group without batches
    assert sum(1 for p in (tmp_path / "out" / "fold").iterdir()) == 5
    files = {f for f in again.inputFiles()}
    assert files and all("group000003" in f or "group000004" in f for f in files)
    assert spark.read.parquet(f"{out}/fold/group000003").count() == len({r[1] for r in rows})


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = changes(60)
    out = str(tmp_path / "out")
    log = pg.FoldedLog(spark.createDataFrame([], SCHEMA), out, "incoming", 2)
    batches = [spark.createDataFrame(rows[i::5], SCHEMA) for i in range(5)]
    for epoch, batch in enumerate(batches):
        log.add(batch, epoch)
        log.add(batch, epoch)  # the sink may see a batch twice
    restarted = pg.FoldedLog(spark.createDataFrame([], SCHEMA), out, "incoming", 2)
    restarted.add(batches[3], 3)  # and again after a restart, where it folds
    restarted.add(batches[4], 4)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(restarted.state()) == key(pg.merge_progress(spark.createDataFrame(rows, SCHEMA)))


def test_ties_on_a_device_stay_with_the_first(spark, tmp_path):
    rows = changes(80, keys=4, seed=5)
    got = pg.run_merge_stream(feed(spark, rows, str(tmp_path / "in"), 6), str(tmp_path / "out"), str(tmp_path / "ck"), ties="local", fold_every=2)
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(got) == key(pg.merge_progress(spark.createDataFrame(rows, SCHEMA), "local"))
