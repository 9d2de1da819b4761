"""Registered queries: burials, neighbours, family, search, lists, counts."""

from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.catalog import sqltext as S
from plotlink.catalog.registry import model, oracle, query, view
from plotlink.operators import anchors as an
from plotlink.operators import burials as bu
from plotlink.operators import family as fa
from plotlink.operators import report as rp
from plotlink.streaming import progress as pg

_BLOCK = S.block("block")
_LOTS = "section in ('Old Part', 'Oak Hill')"
view("o_burial", f"""
  SELECT *, {S.lot_key('lot')} AS lot_key, {S.int_prefix('lot')} AS lot_n, case when {_LOTS} then sub else '' end AS group_sub,
         case when {_LOTS} then '' else block end AS group_block FROM (
    SELECT cem_id, 'mem' AS kind, mid AS id, ord, name, "by", dy, section, coalesce(sub, '') AS sub, {_BLOCK} AS block, lot, grave, flags & 1 <> 0 AS has_photo, false AS hidden
    FROM o_mem_at WHERE section is not null
    UNION ALL SELECT r.cem_id, 'ros', r.key, ord, name, "by", dy, section, coalesce(sub, ''), {_BLOCK}, lot, grave, false, l.key is not null
    FROM o_reg r LEFT JOIN (SELECT DISTINCT cem_id, key FROM o_linked) l ON l.cem_id = r.cem_id AND l.key = r.key WHERE section <> '')""")


@query("burial_union")
def _(t):
    m = model(t)
    return bu.burial_union(m.memorial, m.register, m.linked)


oracle("burial_union", "SELECT * FROM o_burial")

# plots whose neighbours are asked for: the requests' best plots
view("o_target", """
  SELECT mid, cem_id, b_section AS section, coalesce(b_sub, '') AS sub, coalesce(b_block, '') AS block, coalesce(b_lot, '') AS lot FROM o_enriched WHERE b_section <> ''""")
view("o_target_plot", f"""
  SELECT DISTINCT cem_id, section, case when {_LOTS} then sub else '' end AS group_sub, case when {_LOTS} then '' else block end AS group_block, lot, {S.int_prefix('lot')} AS lot_n FROM o_target""")
view("o_neighbor", """
  SELECT t.cem_id, t.section, t.group_sub, t.group_block, t.lot, b.kind, b.id, b.ord, b.name, coalesce(b.grave, '') AS grave, b.has_photo,
         cast(case when t.lot_n is not null and b.lot_n is not null then abs(b.lot_n - t.lot_n) when t.lot <> '' then 0 else 3 end as int) AS dist
  FROM o_target_plot t JOIN o_burial b USING (cem_id, section, group_sub, group_block)
  WHERE NOT b.hidden AND case when t.lot_n is not null and b.lot_n is not null then abs(b.lot_n - t.lot_n) <= 3
    when t.lot <> '' and b.lot <> '' then t.lot = b.lot and t.lot_n is null else t.lot = '' and coalesce(b.lot, '') = '' end""")


def _targets(m):
    e = m.enriched.filter("b_section <> ''")
    return e.select("mid", "cem_id", *[F.coalesce(f"b_{c}", F.lit("")).alias(c) for c in ("section", "sub", "block", "lot")])


@query("neighbors")
def _(t):
    m = model(t)
    return bu.neighbors(_targets(m), m.burial)


oracle("neighbors", "SELECT * FROM o_neighbor")


@query("neighbor_pick")
def _(t):
    m = model(t)
    return bu.neighbor_pick(_targets(m), m.burial)


_ord = "dist, has_photo DESC, grave, kind, ord"
oracle("neighbor_pick", f"""
  SELECT cem_id, mid, kind, id, name, dist, has_photo, cast(row_number() OVER (PARTITION BY mid ORDER BY {_ord}) as int) AS rank FROM (
    SELECT *, case when pic then 0 else sum(case when pic then 0 else 1 end) OVER (PARTITION BY mid ORDER BY {_ord}) end AS fill, count_if(pic) OVER (PARTITION BY mid) AS n_pic FROM (
      SELECT *, has_photo and sum(case when has_photo then 1 else 0 end) OVER (PARTITION BY mid ORDER BY {_ord}) <= 5 AS pic FROM (
        SELECT g.mid, n.* FROM (SELECT *, case when {_LOTS} then sub else '' end AS group_sub, case when {_LOTS} then '' else block end AS group_block FROM o_target) g
        JOIN o_neighbor n USING (cem_id, section, group_sub, group_block, lot) WHERE NOT (n.kind = 'mem' AND n.id = g.mid)))) WHERE pic OR fill <= 14 - n_pic""")


@query("lot_occupants")
def _(t):
    m = model(t)
    return bu.lot_occupants(m.drawn, m.burial)


view("o_occupant", f"""
  SELECT d.cem_id, d.section, d.sub, d.block, d.lot, b.kind, b.id, b.name, b.ord, coalesce(nullif({S.int_prefix('b.grave')}, 0), 99) AS grave_order
  FROM (SELECT DISTINCT cem_id, section, sub, block, lot, {S.int_prefix('lot')} AS lot_n, case when {_LOTS} then sub else '' end AS group_sub,
        case when {_LOTS} then '' else block end AS group_block FROM o_drawn) d
  JOIN o_burial b USING (cem_id, section, group_sub, group_block)
  WHERE NOT b.hidden AND d.lot_n IS NOT DISTINCT FROM b.lot_n AND (d.block = '' OR b.block = '' OR d.block = b.block)""")
oracle("lot_occupants", "SELECT * FROM o_occupant")

view("o_progress", """
  SELECT pk, ts, st, note, tombstone, photo, up, arrival FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ts DESC, arrival DESC) AS rn FROM fx_progress) WHERE rn = 1""")
# the open list after a refresh: every fourth request is gone
view("fx_request_now", "SELECT * FROM fx_request WHERE ord % 4 <> 1")


@query("fulfilled_requests")
def _(t):
    return bu.fulfilled_requests(pg.merge_progress(t.progress), t.request_now, t.memorial)


view("o_fulfilled", """
  SELECT m.cem_id, m.mid, m.name, p.st, p.ts FROM o_progress p JOIN fx_memorial m ON cast(m.mid as varchar) = p.pk
  WHERE p.st IN ('done', 'nostone', 'notfound') AND m.mid NOT IN (SELECT mid FROM fx_request_now)""")
oracle("fulfilled_requests", "SELECT * FROM o_fulfilled")

view("fx_pk", """
  SELECT event_id, case event_id % 3 when 0 then cast(41 * user_id + 6 as string) when 1 then 'ros:' || cast(2 * user_id + 1 as string) else cast(user_id + 1 as string) || '#2' end AS pk FROM events""")


@query("person_by_pk")
def _(t):
    m = model(t)
    return bu.person_by_pk(t.pk, m.memorial, m.register, m.linked)


oracle("person_by_pk", """
  SELECT k.pk, m.cem_id, m.name, m."by", m.dy, m.mid, m.plot AS plot_text FROM (SELECT DISTINCT pk, split_part(pk, '#', 1) AS base FROM fx_pk) k
  JOIN o_mem m ON cast(m.mid as varchar) = k.base
  UNION ALL SELECT k.pk, r.cem_id, r.name, r."by", r.dy, l.mid,
    concat_ws(' ', case when r.section not in ('', '*') then r.section end, case when r.block <> '' then 'Blk ' || r.block end, case when r.lot <> '' then 'Lot ' || r.lot end,
              case when r.grave <> '' then 'Gr ' || r.grave end)
  FROM (SELECT DISTINCT pk, split_part(pk, '#', 1) AS base FROM fx_pk) k JOIN o_reg r ON 'ros:' || r.key = k.base LEFT JOIN o_linked l ON l.cem_id = r.cem_id AND l.key = r.key""")

view("fx_position", """
  SELECT e.event_id AS observer_id, 43e0 + (e.user_id % 50) * 0.01e0 + (e.event_id % 13) * 0.001e0 AS lat, -84e0 - (e.user_id % 50) * 0.0075e0 + (e.event_id % 7) * 0.001e0 AS lng FROM events e""")


@query("nearest_cemetery")
def _(t):
    return bu.nearest_cemetery(t.position, t.cemetery).withColumn("dist_m", F.round("dist_m", 2))


oracle("nearest_cemetery", f"""
  SELECT observer_id, arg_min(cem_id, d) AS cem_id, round(min(d), 2) AS dist_m FROM (
    SELECT p.observer_id, c.cem_id, {S.hav('p.lat', 'p.lng', 'c.lat', 'c.lng')} AS d FROM fx_position p, fx_cemetery c) WHERE d <= 1200 GROUP BY observer_id""")


@query("family_links")
def _(t):
    return fa.family_links(model(t).memorial)


oracle("family_links", """
  SELECT cem_id, mid, kin, count(*) AS n_kin, arg_min(k_mid, k_ord) AS first_kin, case dir when 0 then 'lists' else 'listed_by' end AS direction FROM o_kin_edge GROUP BY cem_id, mid, kin, dir""")


@query("family_members")
def _(t):
    return fa.family_members(model(t).memorial)


oracle("family_members", """
  WITH p AS (SELECT cem_id, kin, mid, 'bears' AS role FROM o_mem_name WHERE kin <> '' UNION ALL SELECT cem_id, kin, mid, 'lists' FROM o_fam_name)
  SELECT * FROM p SEMI JOIN (SELECT cem_id, kin FROM p GROUP BY ALL HAVING count(DISTINCT role) = 2) USING (cem_id, kin)""")


@query("family_hints")
def _(t):
    m = model(t)
    return fa.family_hints(m.request, m.memorial, m.located)


view("o_hint_fam", """
  SELECT q.cem_id, q.ord, q.mid, k.mid AS k_mid, k.name AS k_name, k.ord AS k_ord, k.at_level, 0 AS gap, true AS exact, true AS is_family,
         row_number() OVER (PARTITION BY q.ord ORDER BY e.at) AS seq, least(count(*) OVER (PARTITION BY q.ord), 8) AS n_fam
  FROM o_req q JOIN (SELECT cem_id, mid, k_mid, min((dir, pos, k_ord)) AS at FROM o_kin_edge GROUP BY ALL) e ON e.cem_id = q.cem_id AND e.mid = q.mid
  JOIN o_mem_place k ON k.cem_id = e.cem_id AND k.mid = e.k_mid WHERE q.nl <> ''""")
view("o_hint_other", """
  SELECT * FROM (
    SELECT q.cem_id, q.ord, q.mid, m.mid AS k_mid, m.name AS k_name, m.ord AS k_ord, m.at_level,
           case when q.dy <> 0 and m.dy <> 0 then abs(q.dy - m.dy) when q."by" <> 0 and m."by" <> 0 then abs(q."by" - m."by") else 60 end AS gap,
           q.nl = m.nl or (m.nm <> '' and m.nm = q.nl) AS exact, false AS is_family, m.ord AS seq, 0 AS n_fam
    FROM o_req q JOIN o_mem_place m ON m.cem_id = q.cem_id AND (q.nl = m.nl OR m.nm = q.nl OR q.sx = m.sx)
    WHERE q.nl <> '' AND m.mid <> q.mid AND (m.at_level is not null OR m.flags & 1 <> 0)
      AND NOT EXISTS (SELECT 1 FROM o_hint_fam f WHERE f.ord = q.ord AND f.k_mid = m.mid AND f.seq <= 8))
  WHERE gap <= case when exact then 40 else 5 end""")
oracle("family_hints", """
  SELECT cem_id, ord, mid, cast(rank as int) AS rank, k_mid AS kin_mid, k_name AS kin_name, at_level AS level, gap, exact, is_family FROM (
    SELECT *, row_number() OVER (PARTITION BY ord ORDER BY is_family DESC, exact DESC, gap, (is_family and n_fam >= 8) or at_level is not null DESC, seq) AS rank
    FROM (SELECT * FROM o_hint_fam WHERE seq <= 8 UNION ALL SELECT * FROM o_hint_other)) WHERE rank <= 8""")


@query("suggest_section")
def _(t):
    return an.suggest_section(model(t).request, t.mem_era)


# the test burials fill sections evenly; here sections open one after the other instead
view("fx_mem_era", """
  SELECT cem_id, k AS ord, dy_ AS dy, case when k % 7 = 3 then null when k % 9 = 2 then '*' when k % 5 = 0 then 'Section ' || sec
         else 'Section ' || substr('ABCDEF', cast(floor(dy_ / 25) % 6 + 1 as int), 1) end AS section FROM fx_base""")
oracle("suggest_section", """
  SELECT q.cem_id, q.ord, q.mid, q.dy, s.section AS suggested, cast(floor(100 * s.n / s.total + 0.5) as int) AS share FROM o_req q JOIN (
    SELECT *, row_number() OVER (PARTITION BY ord ORDER BY n DESC, first) AS rn FROM (
      SELECT ord, section, n, first, sum(n) OVER (PARTITION BY ord) AS total FROM (
        SELECT q.ord, m.section, any_value(s.first) AS first, count(*) FILTER (abs(m.dy - q.dy) <= 6) AS n FROM o_req q
        JOIN (SELECT cem_id, section, min(ord) AS first FROM fx_mem_era WHERE section is not null AND dy <> 0 AND section <> '*' GROUP BY ALL HAVING count(*) >= 15) s ON s.cem_id = q.cem_id
        JOIN fx_mem_era m ON m.cem_id = s.cem_id AND m.section = s.section AND m.dy <> 0 WHERE q.dy <> 0 GROUP BY ALL))) s
  ON s.ord = q.ord AND s.rn = 1 WHERE s.total >= 10 AND s.n / s.total >= 0.45""")

# ---- lists and counts ----
_DONE = "('done', 'nostone', 'notfound')"


def _progress(t):
    return pg.merge_progress(t.progress)


@query("request_worklist")
def _(t):
    m = model(t)
    sizes = m.memorial.groupBy("cem_id").agg(F.count("*").alias("n_memorials"))
    df = rp.request_worklist(m.enriched, sizes, "2024-06-01")
    return df.withColumn("leads", F.array_join(F.transform("leads", lambda x: F.concat(x.label, F.lit(":"), x["query"])), " | "))


oracle("request_worklist", """
  SELECT e.cem_id, e.mid, case when level is null then case when ros_no_plot then 'register has no plot'
             when plot <> '' and not regexp_matches(plot, '(?i)no location|unknown') then 'plot not mappable' when s.n BETWEEN 1 AND 400 then 'small cemetery' else 'no plot' end
           when level in ('gps', 'lot') then 'lot' when level in ('adjacent', 'block') then 'block' else 'section' end AS confidence,
         '±' || cast(cast(floor(acc * 3.28084::double + 0.5) as bigint) as varchar) || ' ft' AS acc_label,
         case when "by" = 0 and dy = 0 then '' else coalesce(cast(nullif("by", 0) as varchar), '?') || '–' || coalesce(cast(nullif(dy, 0) as varchar), '?') end AS years,
         claimed <> '' AS claimed, plot_conflict AS verify_plot, ros_verify AS verify_register,
         regexp_matches(created, '20[0-9][0-9]') and date_diff('day', cast(created as date), date '2024-06-01') > 550 AS long_open, coalesce(veteran, false) AS veteran,
         trim(regexp_replace(problem, '\\s+', ' ', 'g')) AS problem,
         concat_ws(' | ', case when dy <> 0 then 'death record:' || fn || '&' || ln || '&' || (dy - 2) || '&' || (dy + 2) end,
           case when dy <> 0 and dy <= 1963 then 'newspaper:' || fn || '%20' || ln || '&' || dy || '&' || least(dy + 1, 1963) end,
           case when veteran then 'veteran locator:' end, 'web:' || fn || '%20' || ln || case when dy <> 0 then '+' || dy else '' end) AS leads
  FROM o_enriched e JOIN (SELECT cem_id, count(*) AS n FROM o_mem GROUP BY 1) s USING (cem_id)""")


@query("header_stats")
def _(t):
    return rp.header_stats(t.request, _progress(t), [1, 2, 3])


oracle("header_stats", f"""
  SELECT count_if(not f) AS open, count_if(f) AS done, count_if(not f and cem_id in (1, 2, 3)) AS open_here
  FROM (SELECT q.cem_id, coalesce(p.st in {_DONE}, false) AS f FROM fx_request q LEFT JOIN o_progress p ON p.pk = cast(q.mid as varchar))""")


@query("finish_list")
def _(t):
    return rp.finished_work(t.request_now, _progress(t), t.memorial)


oracle("finish_list", f"""
  SELECT q.cem_id, q.mid, q.name, p.st, p.up, p.ts, case when p.st = 'done' and p.up then 'uploaded' when p.st = 'done' then 'to_upload' else 'closed' end AS stage
  FROM fx_request_now q JOIN o_progress p ON p.pk = cast(q.mid as varchar) WHERE p.st in {_DONE}
  UNION ALL SELECT cem_id, mid, name, st, false, ts, 'confirmed' FROM o_fulfilled""")


@query("finish_stages")
def _(t):
    return rp.finish_stages(t.request_now, _progress(t), t.memorial)


oracle("finish_stages", f"""
  SELECT stage, count(*) AS n, max(ts) AS newest_ts, arg_max(mid, (ts, mid)) AS newest_mid FROM (
    SELECT q.mid, p.ts, case when p.st = 'done' and p.up then 'uploaded' when p.st = 'done' then 'to_upload' else 'closed' end AS stage
    FROM fx_request_now q JOIN o_progress p ON p.pk = cast(q.mid as varchar) WHERE p.st in {_DONE}
    UNION ALL SELECT mid, ts, 'confirmed' FROM o_fulfilled) GROUP BY stage""")

view("fx_photo", """
  SELECT cast(41 * user_id + 6 as string) || '#' || cast(event_id as string) AS pk, cast(floor(@EPOCH_US(ts)@ / 1000e0) as bigint) AS ts, cast(floor(value * 1000) as bigint) AS size
  FROM events WHERE event_type <> 'signup'""")


@query("photo_queue")
def _(t):
    return rp.photo_queue(t.photo, _progress(t), 1704153600000, 1705363200000)


oracle("photo_queue", """
  SELECT count_if(inr and not u) AS n, round(sum(case when inr and not u then size else 0 end) / 1048576, 1) AS mb, count_if(u) AS n_uploaded FROM (
    SELECT f.size, f.ts >= 1704153600000 and f.ts < 1705363200000 + 86400000 AS inr, coalesce(p.up, false) AS u
    FROM fx_photo f LEFT JOIN o_progress p ON p.pk = split_part(f.pk, '#', 1))""")


@query("section_groups")
def _(t):
    return rp.section_groups(model(t).enriched, _progress(t))


oracle("section_groups", f"""
  SELECT e.cem_id, case when coalesce(b_section, '') = '' then 'No plot on record' when b_section = '*' then 'Rows & lots (no section names here)' else b_section end AS label,
         count_if(not coalesce(p.st in {_DONE}, false)) AS open, count(*) AS total FROM o_enriched e LEFT JOIN o_progress p ON p.pk = cast(e.mid as varchar) GROUP BY 1, 2""")


@query("section_histogram")
def _(t):
    return rp.section_histogram(model(t).register)


oracle("section_histogram", """
  SELECT cem_id, label, n, cast(floor(100 * sum(case when label <> '(none)' then n else 0 end) OVER (PARTITION BY cem_id) / sum(n) OVER (PARTITION BY cem_id) + 0.5) as int) AS located_pct
  FROM (SELECT cem_id, case when section = '' then '(none)' else section end AS label, count(*) AS n FROM o_reg GROUP BY ALL)""")


@query("round_trip_error")
def _(t):
    m = model(t)
    return rp.round_trip_error(m.memorial, m.located, m.cemetery)


oracle("round_trip_error", f"""
  SELECT cem_id, list_sort(list(err))[count(*) // 2 + 1] AS median, list_sort(list(err))[cast(floor(count(*) * 0.9::double) as bigint) + 1] AS p90, count(*) AS n FROM (
    SELECT m.cem_id, round({S.hav('m.lat', 'm.lng', 'l.lat', 'l.lng')}, 2) AS err FROM o_mem_at m JOIN o_located l ON l.cem_id = m.cem_id AND l.section = m.section
      AND l.sub = coalesce(m.sub, '') AND l.block = coalesce(m.block, '') AND l.lot = coalesce(m.lot, '') WHERE m.lat is not null AND l.level <> 'section') GROUP BY cem_id""")

# ---- search ----
TYPED = ["smith", "SMITH", "john sm", "oster eth", "zz", "a", "mary moore", " Mary  Moore", "O'Ster", "J.", "ell"]
_qs = ", ".join(f"({S.q(x)}, {S.norm(S.q(x))})" for x in TYPED)
view("o_hits", f"""
  SELECT q.query, b.*, row_number() OVER (PARTITION BY q.query, b.cem_id ORDER BY b.kind, b.ord) AS rank
  FROM (VALUES {_qs}) q(query, typed) JOIN (
    SELECT cem_id, 'mem' AS kind, mid AS id, ord, name, sk FROM o_mem UNION ALL
    SELECT r.cem_id, 'ros', r.key, r.ord, r.name, r.sk FROM o_reg r WHERE NOT EXISTS (SELECT 1 FROM o_linked l WHERE l.cem_id = r.cem_id AND l.key = r.key)) b
  ON len(q.typed) >= 2 AND len(list_filter(string_split(q.typed, ' '), lambda x: not contains(b.sk, x))) = 0""")


@query("search_burials")
def _(t):
    m = model(t)
    return rp.search_burials(m.memorial, m.register, m.linked, TYPED, 60)


oracle("search_burials", "SELECT query, cem_id, cast(rank as int) AS rank, kind, id, name FROM o_hits WHERE rank <= 60")


@query("search_all")
def _(t):
    m = model(t)
    return rp.search_all(m.memorial, m.register, m.linked, TYPED, 6, 120)


oracle("search_all", """
  WITH per AS (SELECT query, cem_id, least(count(*), 6) AS n, count(*) > 6 AS more FROM o_hits WHERE rank <= 7 GROUP BY ALL),
       run AS (SELECT *, sum(n) OVER (PARTITION BY query ORDER BY cem_id) AS cum FROM per),
       fl AS (SELECT query, bool_or(more) FILTER (cum - n < 120) OR max(cum) >= 120 AS truncated FROM run GROUP BY query)
  SELECT h.query, h.cem_id, cast(h.rank as int) AS rank, h.kind, h.id, h.name, fl.truncated FROM o_hits h JOIN run r ON r.query = h.query AND r.cem_id = h.cem_id AND r.cum - r.n < 120
  JOIN fl ON fl.query = h.query WHERE h.rank <= 6""")

FILTERS = ["smith", "Section A", "row: 5", "ba"]
_fs = ", ".join(f"('{x}')" for x in FILTERS)


@query("filter_requests")
def _(t):
    return rp.filter_requests(model(t).enriched, _progress(t), FILTERS)


oracle("filter_requests", f"""
  SELECT q.query, e.cem_id, e.mid, e.name FROM (VALUES {_fs}) q(query) JOIN (
    SELECT e.*, trim(regexp_replace(lower(concat_ws(' ', name || ' ' || plot, case when r_section is not null then r_section || ' ' || r_block || ' ' || r_lot end)), '[^a-z0-9]+', ' ', 'g')) AS hay,
           coalesce(p.st in {_DONE}, false) AS f FROM o_enriched e LEFT JOIN o_progress p ON p.pk = cast(e.mid as varchar)) e
  ON NOT e.f AND len(list_filter(string_split(trim(regexp_replace(lower(q.query), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: not contains(e.hay, x))) = 0""")

HERE = (43.0201, -84.0152)
GIVEN = ["Section C", "Section A"]


@query("walk_order")
def _(t):
    e = model(t).enriched
    out = None
    for mode in ("name", "conf", "near", "route"):
        df = rp.walk_order(e, mode, HERE, GIVEN).select("cem_id", "mid", F.lit(mode).alias("mode"), "rank")
        out = df if out is None else out.unionByName(df)
    return out


def _nat(x):
    return S.rep(S.rep(f"lower({x})", "([0-9]+)", r"0000000000\1"), "0*([0-9]{10})([^0-9]|$)", r"\1\2")


_modes = {
    "name": S.norm("ln"),
    "conf": "case level when 'gps' then 0 when 'lot' then 1 when 'adjacent' then 2 when 'block' then 3 when 'section' then 4 when 'family' then 5 else 9 end",
    "near": f"coalesce(round({S.hav(f'{HERE[0]}::double', f'({HERE[1]})::double', 'lat', 'lng')}, 2), 1e9)",
    "route": f"""case b_section when 'Section C' then 0 when 'Section A' then 1 else 99 end, case when b_section = '*' then 0 when coalesce(b_section, '') = '' then 1 else 2 end,
                 {_nat("coalesce(b_section, '')")}, {_nat("coalesce(b_block, '')")}, coalesce({S.int_prefix('b_lot')}, 9999)""",
}
oracle("walk_order", " UNION ALL ".join(
    f"SELECT cem_id, mid, '{m}' AS mode, cast(row_number() OVER (PARTITION BY cem_id ORDER BY {k}, ord) as int) AS rank FROM o_enriched" for m, k in _modes.items()))

view("fx_cemetery_miles", "SELECT cem_id, name, lat, lng, interments, round(abs(cem_id * 7 % 25 - 3) * 1.3e0, 1) AS miles FROM fx_cemetery")


@query("walk_preview")
def _(t):
    return rp.walk_preview(model(t).enriched, t.cemetery_miles)


oracle("walk_preview", """
  SELECT c.miles, e.cem_id, cast(rank as int) AS rank, mid, e.name, n_open, greatest(n_open - 4, 0) AS n_more FROM (
    SELECT *, row_number() OVER (PARTITION BY cem_id ORDER BY ord) AS rank, count(*) OVER (PARTITION BY cem_id) AS n_open FROM o_enriched) e
  JOIN fx_cemetery_miles c USING (cem_id) WHERE rank <= 4""")


@query("map_layers")
def _(t):
    m = model(t)
    df = rp.map_layers(m.memorial, m.register, m.register_pins, m.linked, m.located, m.drawn, m.burial, m.section, m.enriched, _progress(t), m.cemetery)
    return df.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


oracle("map_layers", f"""
  WITH drawn_reg AS (SELECT l.cem_id, l.key FROM o_linked l JOIN o_mem_at m ON m.cem_id = l.cem_id AND m.mid = l.mid WHERE m.lat is not null),
       open_reg AS (SELECT * FROM o_reg r WHERE r.section <> '' AND NOT EXISTS (SELECT 1 FROM drawn_reg d WHERE d.cem_id = r.cem_id AND d.key = r.key))
  SELECT layer, cem_id, id, round(lat, 6) AS lat, round(lng, 6) AS lng, label, cls, n, soft FROM (
    SELECT 'grave' AS layer, cem_id, cast(mid as varchar) AS id, lat, lng, last AS label, case when field_pin then 'pin' else 'memorial' end AS cls, null::bigint AS n, false AS soft FROM (
      SELECT m.*, row_number() OVER (PARTITION BY m.cem_id, round(m.lat, 6), round(m.lng, 6) ORDER BY ord) AS rn FROM o_mem_at m JOIN fx_cemetery c USING (cem_id)
      WHERE {S.hav('m.lat', 'm.lng', 'c.lat', 'c.lng')} BETWEEN 5 AND 800) WHERE rn = 1
    UNION ALL SELECT 'register', r.cem_id, cast(r.key as varchar), p.lat, p.lng, r.last, 'pin', null, false FROM open_reg r JOIN o_reg_pin p ON p.cem_id = r.cem_id AND p.key = r.key
    UNION ALL SELECT 'register', r.cem_id, cast(r.key as varchar), l.lat, l.lng, r.last, 'register', null, false FROM open_reg r JOIN o_located l ON l.cem_id = r.cem_id
      AND l.section = r.section AND l.sub = r.sub AND l.block = r.block AND l.lot = r.lot
      WHERE l.level IN ('lot', 'adjacent') AND NOT EXISTS (SELECT 1 FROM o_reg_pin p WHERE p.cem_id = r.cem_id AND p.key = r.key)
    UNION ALL SELECT 'lot', d.cem_id, d.section || '|' || d.block || '|' || d.lot, {S.to_lat('d.n', 'd.clat')}, {S.to_lng('d.e', 'd.clat', 'd.clng')}, d.lot, 'lot', coalesce(o.n, 0), false
      FROM o_drawn d LEFT JOIN (SELECT cem_id, section, sub, block, lot, count(*) AS n FROM o_occupant GROUP BY ALL) o USING (cem_id, section, sub, block, lot)
    UNION ALL SELECT 'section', cem_id, section, lat, lng, section, 'section', null, false FROM o_section WHERE section <> '*'
    UNION ALL SELECT 'target', e.cem_id, cast(e.mid as varchar), e.lat, e.lng, e.ln, case when p.st = 'done' then 'done' when coalesce(p.st, '') <> '' then 'tried' else 'open' end, null,
      e.level IN ('family', 'section') FROM o_enriched e LEFT JOIN o_progress p ON p.pk = cast(e.mid as varchar) WHERE e.lat is not null)""")
