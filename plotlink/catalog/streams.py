"""Registered queries: progress, pins and snapshots as streams."""

import uuid

from pyspark.sql import functions as F

from plotlink.catalog import fixtures
from plotlink.catalog.places import clusters_sql
from plotlink.catalog.registry import VIEWS, model, oracle, query, view
from plotlink.catalog.views import with_views
from plotlink.functions.lineage import shared_root
from plotlink.operators import standardize as std
from plotlink.streaming import progress as pg
from plotlink.streaming import refit as rf


#: Files that the event table arrives in, one a batch.
ARRIVALS = 6


def _event_stream(t, fixture):
    """A fixture view over the event table read as a stream (static tables stay static). The events arrive in
    several files, dealt out of their order, each a batch of its own."""
    events = t.raw("events")
    path = f"{shared_root(t.spark)}/arrivals-{uuid.uuid4().hex}"
    events.repartition(ARRIVALS, F.xxhash64("event_id")).write.parquet(path)
    name = f"events_stream_{uuid.uuid4().hex[:8]}"
    t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path).createOrReplaceTempView(name)
    base = {b: f"SELECT * FROM parquet.`{t.sf_dir}/{b}.parquet`" for b in fixtures.BASE_TABLES}
    base["events"] = f"SELECT * FROM {name}"
    return t.spark.sql(with_views(f"SELECT * FROM {fixture}", VIEWS, "spark", base))


def _dirs(t, name):
    root = f"{shared_root(t.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


@query("progress_merge")
def _(t):
    return pg.run_merge_stream(_event_stream(t, "fx_progress"), *_dirs(t, "progress"), fold_every=4)


oracle("progress_merge", "SELECT * FROM o_progress")


@query("progress_merge_client")
def _(t):
    return pg.merge_progress(t.progress, ties="local")


oracle("progress_merge_client", """
  SELECT pk, ts, st, note, tombstone, photo, up, arrival FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC, arrival) AS rn FROM fx_progress) WHERE rn = 1""")

view("fx_pin_event", """
  SELECT event_id AS arrival, cast(floor(@EPOCH_US(ts)@ / 3600000000e0) as bigint) AS ts, 41 * user_id + 5 AS k FROM events WHERE event_type = 'view'""")


def _pin_stream(t):
    at = t.pin.select("arrival", "cem_id", "pk", "lat", "lng")
    return _event_stream(t, "fx_pin_event").join(at, "arrival").select("arrival", "ts", "cem_id", "pk", "lat", "lng")


def _before_pins(t):
    """Memorials as they are without any field pin."""
    def build():
        mem = std.clean_pins(t.memorial, t.cemetery).withColumns({"lat": F.col("pin_lat"), "lng": F.col("pin_lng")})
        return std.memorial_table(mem.drop("pin_lat", "pin_lng", "reason", "e", "n"))

    return model(t)._stage("memorial_before_pins", build)


@query("live_refit")
def _(t):
    m, mem = model(t), _before_pins(t)
    df = rf.run_refit_stream(_pin_stream(t), lambda pins: rf.refit_lots(pins, mem, m.register, m.cemetery), *_dirs(t, "refit"))
    return df.withColumns({"e": F.round("e", 2), "n": F.round("n", 2), "spread": F.round("spread", 4)})


@query("live_refit_rows")
def _(t):
    m, mem = model(t), _before_pins(t)
    linked, drawn = m.linked, m.drawn
    return rf.run_refit_stream(_pin_stream(t), lambda pins: rf.refit_rows(pins, mem, m.register, m.cemetery, linked, drawn), *_dirs(t, "rows"))


oracle("live_refit_rows", "SELECT * FROM o_walk WHERE cem_id IN (SELECT cem_id FROM fx_pin)")
view("o_refit_anchor", "SELECT * FROM o_gps_anchor WHERE cem_id IN (SELECT cem_id FROM fx_pin)")
view("o_refit_cluster", clusters_sql("o_refit_anchor", ["cem_id", "section", "sub", "block", "lot_key"]))
oracle("live_refit", "SELECT * REPLACE (round(e, 2) AS e, round(n, 2) AS n, round(spread, 4) AS spread) FROM o_refit_cluster")


@query("backup_restore")
def _(t):
    p = t.progress
    cur = pg.merge_progress(p.filter("arrival % 3 <> 0"))
    bak = pg.merge_progress(p.filter("arrival % 3 = 0"))
    return pg.backup_restore(cur, bak)


oracle("backup_restore", """
  WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC, arrival DESC) AS rn FROM fx_progress WHERE arrival % 3 <> 0) WHERE rn = 1),
       bak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC, arrival DESC) AS rn FROM fx_progress WHERE arrival % 3 = 0) WHERE rn = 1)
  SELECT pk, ts, st, note, tombstone, photo, up, true AS from_backup FROM bak b WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.pk = b.pk AND c.ts > b.ts)
  UNION ALL SELECT pk, ts, st, note, tombstone, photo, up, false FROM cur c WHERE NOT EXISTS (SELECT 1 FROM bak b WHERE b.pk = c.pk AND b.ts >= c.ts)""")

view("fx_update_row", """
  SELECT cast(k % 30 + 1 as int) AS cem_id, case when k % 30 = 4 and k % 7 = 0 then null else k + 1 end AS mid FROM fx_base""")


@query("backup_updates")
def _(t):
    return pg.backup_updates(t.update_row, t.cemetery)


oracle("backup_updates", """
  SELECT u.cem_id, count(*) AS n_rows, count_if(u.mid is null) AS n_bad, count_if(u.mid is null) = 0 AND any_value(c.cem_id) is not null AS accepted
  FROM fx_update_row u LEFT JOIN fx_cemetery c ON c.cem_id = u.cem_id GROUP BY u.cem_id""")


@query("request_diff")
def _(t):
    q = t.request
    return pg.request_diff(q.filter("ord % 5 <> 2"), q.filter("ord % 4 <> 1"))


oracle("request_diff", """
  SELECT cem_id, mid, case when ord % 5 = 2 then 'opened' when ord % 4 = 1 then 'vanished' else 'open' end AS state FROM fx_request WHERE ord % 5 <> 2 OR ord % 4 <> 1""")
