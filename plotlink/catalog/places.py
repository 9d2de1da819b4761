"""Registered queries: anchors, sections, walk rows, the cascade, the flagship."""

from pyspark.sql import functions as F

from plotlink.catalog import sqltext as S
from plotlink.catalog.registry import model, oracle, query, view
from plotlink.operators import anchors as an
from plotlink.operators import maintain as mt
from plotlink.operators import standardize as std
from plotlink.plans import enrich, locate

r2 = lambda c: F.round(c, 2).alias(c)
r6 = lambda c: F.round(c, 6).alias(c)

# memorials and register rows after pin cleaning and field pins
view("o_pin_last", f"""
  SELECT p.cem_id, p.pk, p.lat, p.lng FROM (SELECT *, row_number() OVER (PARTITION BY cem_id, pk ORDER BY ts DESC, arrival DESC) AS rn FROM fx_pin) p
  JOIN fx_cemetery c USING (cem_id) WHERE rn = 1 AND {S.hav('p.lat', 'p.lng', 'c.lat', 'c.lng')} <= 800""")
view("o_mem_at", """
  SELECT m.* EXCLUDE (lat, lng), coalesce(p.lat, c.pin_lat) AS lat, coalesce(p.lng, c.pin_lng) AS lng, p.lat is not null AS field_pin
  FROM o_mem m JOIN o_pins c ON m.cem_id = c.cem_id AND m.mid = c.mid LEFT JOIN o_pin_last p ON p.cem_id = m.cem_id AND p.pk = cast(m.mid as varchar)""")
view("o_reg_pin", """
  SELECT r.*, p.lat, p.lng FROM o_reg r JOIN o_pin_last p ON p.cem_id = r.cem_id AND p.pk = 'ros:' || r.key""")


@query("overlay_field_pins")
def _(t):
    m = std.clean_pins(t.memorial, t.cemetery).select("cem_id", "mid", F.col("pin_lat").alias("lat"), F.col("pin_lng").alias("lng"))
    persons = m.select("cem_id", F.col("mid").cast("string").alias("pk"), "lat", "lng").unionByName(t.register.select(
        "cem_id", F.concat(F.lit("ros:"), F.col("key")).alias("pk"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng")))
    return mt.overlay_field_pins(persons, mt.latest_pins(t.pin, t.cemetery))


oracle("overlay_field_pins", """
  SELECT cem_id, cast(mid as varchar) AS pk, lat, lng, field_pin FROM o_mem_at
  UNION ALL SELECT r.cem_id, 'ros:' || r.key, p.lat, p.lng, p.lat is not null FROM fx_register r LEFT JOIN o_reg_pin p ON r.cem_id = p.cem_id AND r.key = p.key""")

_E, _N = f"round({S.east('x.lng', 'c.lat', 'c.lng')}, 4)", f"round({S.north('x.lat', 'c.lat')}, 4)"
view("o_gps_anchor", f"""
  SELECT x.cem_id, x.section, x.sub, x.block, {S.lot_key('x.lot')} AS lot_key, {_E} AS e, {_N} AS n, x.src, x.ord
  FROM (SELECT cem_id, section, sub, block, lot, lat, lng, 'memorial' AS src, ord FROM
          (SELECT *, row_number() OVER (PARTITION BY cem_id, round(lat, 6), round(lng, 6) ORDER BY ord) AS rn FROM o_mem_at WHERE lat is not null AND section is not null) WHERE rn = 1
        UNION ALL SELECT cem_id, section, sub, block, lot, lat, lng, 'field', ord FROM o_reg_pin WHERE section <> '') x JOIN fx_cemetery c USING (cem_id)""")


@query("gps_anchors")
def _(t):
    m = model(t)
    return an.gps_anchors(m.memorial, m.register_pins, m.cemetery).withColumns({"e": F.round("e", 2), "n": F.round("n", 2)})


oracle("gps_anchors", "SELECT * REPLACE (round(e, 2) AS e, round(n, 2) AS n) FROM o_gps_anchor")

view("o_linked", """
  SELECT cem_id, key, mid, score FROM o_links WHERE status = 'link' UNION ALL SELECT cem_id, key, mid, 60 FROM o_era_steps WHERE mid is not null""")
view("o_reg_anchor", f"""
  SELECT x.cem_id, x.section, x.sub, x.block, x.lot_key, {_E} AS e, {_N} AS n, 'register' AS src, x.ord FROM (
    SELECT *, row_number() OVER (PARTITION BY cem_id, section, sub, block, lot_key, round(lat, 6), round(lng, 6) ORDER BY ord) AS rn FROM (
      SELECT r.cem_id, r.ord, r.section, r.sub, r.block, {S.lot_key('r.lot')} AS lot_key, m.lat, m.lng
      FROM o_reg r JOIN o_linked l ON r.cem_id = l.cem_id AND r.key = l.key JOIN o_mem_at m ON m.cem_id = l.cem_id AND m.mid = l.mid
      WHERE r.section <> '' AND m.lat is not null AND (m.section is null
        OR NOT (r.section = m.section AND r.sub = m.sub AND r.block = m.block AND {S.lot_key('r.lot')} = {S.lot_key('m.lot')})))) x
  JOIN fx_cemetery c USING (cem_id) WHERE rn = 1""")


@query("register_anchors")
def _(t):
    m = model(t)
    return an.register_anchors(m.register, m.linked, m.memorial, m.cemetery).withColumns({"e": F.round("e", 2), "n": F.round("n", 2)})


oracle("register_anchors", "SELECT * REPLACE (round(e, 2) AS e, round(n, 2) AS n) FROM o_reg_anchor")
view("o_anchor", "SELECT * FROM o_gps_anchor UNION ALL SELECT * FROM o_reg_anchor")


def clusters_sql(src, keys):
    """Upper medians by sorting: element floor(n/2), zero-based, of the ascending list."""
    k = ", ".join(keys)
    med = lambda c: f"list_sort(list({c}))[count(*) // 2 + 1]"
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    ak = ", ".join(f"a.{c}" for c in keys)
    return f"""
      SELECT {ak}, any_value(b.e) AS e, any_value(b.n) AS n, any_value(b.pins) AS pins, any_value(b.n_all) AS n_all,
             sqrt(sum(pow(a.e - b.e, 2) + pow(a.n - b.n, 2)) / count(*)) AS spread
      FROM (SELECT *, bool_or(near) OVER (PARTITION BY {k}) AS some_ FROM (
              SELECT a.*, sqrt(pow(a.e - b.e0, 2) + pow(a.n - b.n0, 2)) <= 25 AS near
              FROM {src} a JOIN (SELECT {k}, {med('e')} AS e0, {med('n')} AS n0 FROM {src} GROUP BY {k}) b ON {on})) a
      JOIN (SELECT {k}, {med('e')} AS e, {med('n')} AS n, count(*) AS pins, any_value(n_all) AS n_all FROM (
              SELECT * FROM (SELECT *, bool_or(near) OVER (PARTITION BY {k}) AS some_, count(*) OVER (PARTITION BY {k}) AS n_all FROM (
                SELECT a.*, sqrt(pow(a.e - b.e0, 2) + pow(a.n - b.n0, 2)) <= 25 AS near
                FROM {src} a JOIN (SELECT {k}, {med('e')} AS e0, {med('n')} AS n0 FROM {src} GROUP BY {k}) b ON {on})) WHERE near OR NOT some_) GROUP BY {k}) b
      ON {on} WHERE a.near OR NOT a.some_ GROUP BY {ak}"""


LOT = ["cem_id", "section", "sub", "block", "lot_key"]
view("o_cluster", clusters_sql("o_anchor", LOT))
view("o_block_anchor", "SELECT * FROM o_anchor WHERE block <> ''")
view("o_block_cluster", clusters_sql("o_block_anchor", LOT[:4]))


@query("anchor_clusters")
def _(t):
    c = an.anchor_clusters(model(t).anchor)
    return c.select(*LOT, r2("e"), r2("n"), F.round("spread", 4).alias("spread"), "pins", "n_all")


oracle("anchor_clusters", "SELECT * REPLACE (round(e, 2) AS e, round(n, 2) AS n, round(spread, 4) AS spread) FROM o_cluster")

view("o_section_d", """
  SELECT a.*, m.ce, m.cn, m.anchors, round(sqrt(pow(a.e - m.ce, 2) + pow(a.n - m.cn, 2)), 2) AS d
  FROM o_anchor a JOIN (SELECT cem_id, section, list_sort(list(e))[count(*) // 2 + 1] AS ce, list_sort(list(n))[count(*) // 2 + 1] AS cn, count(*) AS anchors
    FROM o_anchor WHERE cem_id NOT IN (SELECT cem_id FROM fx_section_given) GROUP BY ALL HAVING count(*) >= 3) m USING (cem_id, section)""")
view("o_section", f"""
  SELECT s.cem_id, s.section, round({S.to_lat('any_value(cn)', 'any_value(c.lat)')}, 6) AS lat, round({S.to_lng('any_value(ce)', 'any_value(c.lat)', 'any_value(c.lng)')}, 6) AS lng,
         any_value(anchors) AS anchors, cast(floor(least(160, greatest(30, list_sort(list(d))[cast(floor(0.8::double * (count(*) - 1)) as bigint) + 1])) + 0.5) as int) AS radius, true AS derived
  FROM o_section_d s JOIN fx_cemetery c USING (cem_id) GROUP BY s.cem_id, s.section
  UNION ALL SELECT cem_id, section, lat, lng, null::bigint, radius, false FROM fx_section_given""")


@query("derive_sections")
def _(t):
    m = model(t)
    return an.derive_sections(m.anchor, t.section_given, t.cemetery)


oracle("derive_sections", "SELECT * FROM o_section")

# walk rows
view("o_walk_pin", """
  SELECT cem_id, key, lat, lng FROM o_reg_pin
  UNION ALL SELECT l.cem_id, l.key, m.lat, m.lng FROM o_linked l JOIN o_mem_at m ON m.cem_id = l.cem_id AND m.mid = l.mid
  WHERE m.lat is not null AND NOT EXISTS (SELECT 1 FROM o_reg_pin p WHERE p.cem_id = l.cem_id AND p.key = l.key)""")
view("o_walk_cell", f"""
  SELECT x.cem_id, x.section, x.block, {S.int_prefix('x.lot')} AS pos, avg(case when p.lat is not null then round({S.east('p.lng', 'c.lat', 'c.lng')}, 4) end) AS e,
         avg(case when p.lat is not null then round({S.north('p.lat', 'c.lat')}, 4) end) AS n
  FROM o_reg x JOIN fx_cemetery c USING (cem_id) LEFT JOIN o_walk_pin p ON p.cem_id = x.cem_id AND p.key = x.key
  WHERE x.section <> '' AND x.block <> '' AND {S.int_prefix('x.lot')} is not null GROUP BY ALL""")
view("o_walk_fit", """
  SELECT *, (np * spe - sp * se0) / den AS se, (np * spn - sp * sn0) / den AS sn,
         (se0 - (np * spe - sp * se0) / den * sp) / np AS ie, (sn0 - (np * spn - sp * sn0) / den * sp) / np AS in_
  FROM (SELECT cem_id, section, block, count(*) AS np, min(pos) AS lo, max(pos) AS hi, sum(pos)::double AS sp, sum(e) AS se0, sum(n) AS sn0,
               sum(pos * e) AS spe, sum(pos * n) AS spn, (count(*) * sum(pos * pos) - sum(pos) * sum(pos))::double AS den
        FROM o_walk_cell WHERE e is not null GROUP BY ALL HAVING count(*) >= 2)""")
view("o_walk_res", """
  SELECT w.cem_id, w.section, w.block, f.np, round(sqrt(pow(f.ie + f.se * w.pos - w.e, 2) + pow(f.in_ + f.sn * w.pos - w.n, 2)), 3) AS res
  FROM o_walk_cell w JOIN o_walk_fit f USING (cem_id, section, block) WHERE w.e is not null AND sqrt(f.se * f.se + f.sn * f.sn) BETWEEN 0.5 AND 5""")
view("o_walk_good", """
  SELECT cem_id, section, block FROM o_walk_res GROUP BY ALL HAVING any_value(np) < 3 OR list_sort(list(res))[count(*) // 2 + 1] <= 8""")
view("o_walk", """
  SELECT w.cem_id, w.section, w.block, cast(w.pos as varchar) AS lot, round(f.ie + f.se * w.pos, 2) AS e, round(f.in_ + f.sn * w.pos, 2) AS n, l.loo_median,
         case when l.loo_median <= 4 then 'fair' else 'approx' end AS quality
  FROM o_walk_cell w JOIN o_walk_good g USING (cem_id, section, block) JOIN o_walk_fit f USING (cem_id, section, block)
  JOIN (SELECT cem_id, floor(list_sort(list(res))[count(*) // 2 + 1] * 10 + 0.5) / 10 AS loo_median FROM o_walk_res r JOIN o_walk_good USING (cem_id, section, block) GROUP BY cem_id) l USING (cem_id)
  WHERE w.pos BETWEEN f.lo - least(6, greatest(2, f.hi - f.lo)) AND f.hi + least(6, greatest(2, f.hi - f.lo))
    AND NOT EXISTS (SELECT 1 FROM o_drawn d WHERE d.cem_id = w.cem_id AND d.section = w.section AND d.block = w.block AND d.lot = cast(w.pos as varchar))""")


@query("fit_walk_rows")
def _(t):
    m = model(t)
    return an.fit_walk_rows(m.register, m.linked, m.memorial, m.register_pins, m.drawn, m.cemetery)


oracle("fit_walk_rows", "SELECT * FROM o_walk")

# grounds: even-odd test and distance to edges
view("o_edge", """
  SELECT a.cem_id, a.poly, a.lat AS yi, a.lng AS xi, b.lat AS yj, b.lng AS xj FROM fx_ground_vertex a JOIN fx_ground_vertex b
    ON a.cem_id = b.cem_id AND a.poly = b.poly AND b.v = (a.v + a.n_v - 1) % a.n_v""")
view("o_plat_ll", f"SELECT *, {S.to_lat('n', 'clat')} AS lat, {S.to_lng('e', 'clat', 'clng')} AS lng FROM o_plat")
view("o_edge_d", f"""
  SELECT map_id, ord, poly, ((xi > lng) <> (xj > lng)) AND lat < (yj - yi) * (lng - xi) / nullif(xj - xi, 0) + yi AS crosses,
         sqrt(pow(px - t * vx, 2) + pow(py - t * vy, 2)) AS d FROM (
    SELECT *, greatest(0, least(1, (px * vx + py * vy) / case when vx * vx + vy * vy = 0 then 1 else vx * vx + vy * vy end)) AS t FROM (
      SELECT p.map_id, p.ord, p.lat, p.lng, e.*, (e.xi - e.xj) * {S.DEG} * cos(radians(p.lat)) AS vx, (e.yi - e.yj) * {S.DEG} AS vy,
             (p.lng - e.xj) * {S.DEG} * cos(radians(p.lat)) AS px, (p.lat - e.yj) * {S.DEG} AS py
      FROM o_plat_ll p JOIN o_edge e USING (cem_id)))""")
view("o_off", """
  SELECT map_id, ord, min(off) AS off_m FROM (
    SELECT map_id, ord, poly, case when count_if(crosses) % 2 = 1 then 0 else min(d) END AS off FROM o_edge_d GROUP BY ALL) GROUP BY ALL""")
view("o_drawn", """
  SELECT p.* FROM o_plat p LEFT JOIN o_off o USING (map_id, ord) WHERE o.off_m is null OR o.off_m <= 25""")


@query("out_of_bounds_filter")
def _(t):
    from plotlink.operators import burials as bu
    full = std.project_plats(t.plat_map, t.plat_entry, t.cemetery)
    return bu.out_of_bounds(full, t.ground_vertex).select("cem_id", "map_id", "ord", "outside", F.round("off_m", 2).alias("off_m"))


oracle("out_of_bounds_filter", """
  SELECT p.cem_id, p.map_id, p.ord, coalesce(o.off_m > 25, false) AS outside, case when o.off_m <= 25 then round(o.off_m, 2) end AS off_m FROM o_plat p LEFT JOIN o_off o USING (map_id, ord)""")

# the cascade
view("o_all_plat", """
  SELECT cem_id, map_ord, section, sub, style, quality, loo_median, ord, block, lot, e, n FROM o_drawn
  UNION ALL SELECT cem_id, 1000, section, '', 'rows', quality, loo_median, cast(lot as bigint), block, lot, e, n FROM o_walk""")
view("o_want", f"""
  SELECT DISTINCT cem_id, section, coalesce(sub, '') AS sub, coalesce(block, '') AS block, coalesce(lot, '') AS lot, {S.int_prefix('lot')} AS lot_n
  FROM (SELECT cem_id, section, sub, block, lot FROM o_mem_at UNION ALL SELECT cem_id, section, sub, block, lot FROM o_reg
        UNION ALL SELECT cem_id, section, sub, block, lot FROM o_req) WHERE section is not null AND section <> ''""")
_P = "p.cem_id, p.section, p.sub, p.block, p.lot"
_ON = "m.cem_id = p.cem_id AND m.section = p.section AND (p.section <> 'Old Part' OR p.sub = '' OR m.sub = p.sub)"
_BLK = "(p.block = '' OR m.block = p.block OR m.style = 'lots')"
_acc = lambda bump: (f"cast(floor(case quality when 'good' then greatest(coalesce(nullif(loo_median, 0), 5), 5) when 'fair' then 11 when 'approx' then 14 else 28 end + {bump} + 0.5) as int)")
view("o_t1", f"""
  SELECT cem_id, section, sub, block, lot, 1 AS tier, e, n, {_acc(0)} AS acc, 'lot' AS level, 'plat' AS src, null::bigint AS pins FROM (
    SELECT *, row_number() OVER (PARTITION BY cem_id, section, sub, block, lot ORDER BY map_ord) AS rn FROM (
      SELECT {_P}, m.map_ord, m.quality, m.loo_median, case when count(*) = 1 then min(m.e) else min(m.e) FILTER (m.block = p.block) end AS e,
             case when count(*) = 1 then min(m.n) else min(m.n) FILTER (m.block = p.block) end AS n
      FROM o_want p JOIN o_all_plat m ON {_ON} AND {_BLK} AND m.lot = coalesce(cast(p.lot_n as varchar), p.lot)
      GROUP BY {_P}, m.map_ord, m.quality, m.loo_median HAVING count(*) = 1 OR (p.block <> '' AND count(*) FILTER (m.block = p.block) = 1))) WHERE rn = 1""")
view("o_t2", f"""
  SELECT {_P}, 2, c.e, c.n, cast(floor(least(18, greatest(f, f + round(c.spread, 6) / 2)) + 0.5) as int), 'lot', 'anchors', c.pins
  FROM o_want p JOIN (SELECT *, case when pins = 1 then 10 else 6 end AS f FROM o_cluster) c USING (cem_id, section, sub, block)
  WHERE p.lot <> '' AND c.lot_key = coalesce(cast(p.lot_n as varchar), p.lot)""")
view("o_t3", f"""
  SELECT cem_id, section, sub, block, lot, 3, e, n, {_acc(4)}, 'adjacent', 'plat', null::bigint FROM (
    SELECT *, row_number() OVER (PARTITION BY cem_id, section, sub, block, lot ORDER BY map_ord) AS rn2 FROM (
      SELECT cem_id, section, sub, block, lot, map_ord, quality, loo_median, sum(e / (1 + d)) / sum(1::double / (1 + d)) AS e, sum(n / (1 + d)) / sum(1::double / (1 + d)) AS n
      FROM (SELECT {_P}, m.map_ord, m.quality, m.loo_median, m.e, m.n, abs({S.int_prefix('m.lot')} - p.lot_n) AS d,
                   row_number() OVER w AS rn, count(*) OVER (PARTITION BY {_P}, m.map_ord) AS c, min(abs({S.int_prefix('m.lot')} - p.lot_n)) OVER (PARTITION BY {_P}, m.map_ord) AS dmin
            FROM o_want p JOIN o_all_plat m ON {_ON} AND {_BLK} WHERE p.lot_n is not null AND {S.int_prefix('m.lot')} is not null
            WINDOW w AS (PARTITION BY {_P}, m.map_ord ORDER BY abs({S.int_prefix('m.lot')} - p.lot_n), m.ord))
      WHERE rn <= 3 AND d <= 6 AND c >= 2 AND dmin <= 4 GROUP BY ALL)) WHERE rn2 = 1""")
view("o_t4", f"""
  SELECT cem_id, section, sub, block, lot, 4, sum(e / (1 + d)) / sum(1::double / (1 + d)), sum(n / (1 + d)) / sum(1::double / (1 + d)),
         case when sum(pins) > 1 then 14 else 17 end, 'adjacent', 'anchors', cast(sum(pins) as bigint) FROM (
    SELECT *, count_if(d <= 1) OVER w AS n1, count_if(d <= 2) OVER w AS n2 FROM (
      SELECT {_P}, c.e, c.n, c.pins, abs(cast(c.lot_key as bigint) - p.lot_n) AS d FROM o_want p JOIN o_cluster c USING (cem_id, section, sub, block)
      WHERE p.lot_n is not null AND c.lot_key = cast(try_cast(c.lot_key as bigint) as varchar) AND abs(try_cast(c.lot_key as bigint) - p.lot_n) BETWEEN 1 AND 3)
    WINDOW w AS (PARTITION BY cem_id, section, sub, block, lot)) WHERE d <= case when n1 >= 2 then 1 when n2 >= 2 then 2 else 3 end GROUP BY cem_id, section, sub, block, lot""")
view("o_t5", f"""
  SELECT cem_id, section, sub, block, lot, 5, e, n, {_acc(14)}, 'block', 'plat', null::bigint FROM (
    SELECT *, row_number() OVER (PARTITION BY cem_id, section, sub, block, lot ORDER BY map_ord) AS rn FROM (
      SELECT {_P}, m.map_ord, m.quality, m.loo_median, avg(m.e) AS e, avg(m.n) AS n FROM o_want p JOIN o_all_plat m ON {_ON} AND m.block = p.block
      WHERE p.block <> '' GROUP BY {_P}, m.map_ord, m.quality, m.loo_median HAVING count(*) >= 2)) WHERE rn = 1""")
view("o_t6", f"""
  SELECT {_P}, 6, c.e, c.n, cast(floor(least(45, greatest(18, 15 + round(c.spread, 6) / 2)) + 0.5) as int), 'block', 'anchors', c.pins
  FROM o_want p JOIN o_block_cluster c USING (cem_id, section, sub, block) WHERE c.n_all >= 2""")
view("o_t7", f"""
  SELECT {_P}, 7, {S.east('s.lng', 'c.lat', 'c.lng')}, {S.north('s.lat', 'c.lat')}, coalesce(nullif(s.radius, 0), 45), 'section', 'section', null::bigint
  FROM o_want p JOIN o_section s USING (cem_id, section) JOIN fx_cemetery c USING (cem_id)""")
view("o_located", f"""
  SELECT t.cem_id, t.section, t.sub, t.block, t.lot, t.tier, t.e, t.n, t.acc, t.level, t.src, t.pins,
         coalesce(t.tier = 1 AND sqrt(pow(t.e - a.e, 2) + pow(t.n - a.n, 2)) > 25, false) AS disputed,
         {S.to_lat('t.n', 'c.lat')} AS lat, {S.to_lng('t.e', 'c.lat', 'c.lng')} AS lng
  FROM (SELECT *, row_number() OVER (PARTITION BY cem_id, section, sub, block, lot ORDER BY tier) AS rn FROM (
          SELECT * FROM o_t1 UNION ALL SELECT * FROM o_t2 UNION ALL SELECT * FROM o_t3 UNION ALL SELECT * FROM o_t4 UNION ALL SELECT * FROM o_t5
          UNION ALL SELECT * FROM o_t6 UNION ALL SELECT * FROM o_t7)) t
  JOIN fx_cemetery c USING (cem_id)
  LEFT JOIN (SELECT cem_id, section, sub, block, lot, e, n FROM o_t2 t2(cem_id, section, sub, block, lot, tier, e, n, acc, level, src, pins)) a
    ON a.cem_id = t.cem_id AND a.section = t.section AND a.sub = t.sub AND a.block = t.block AND a.lot = t.lot
  WHERE t.rn = 1""")


@query("locate_plots")
def _(t):
    m = model(t)
    cols = ["cem_id", "section", "sub", "block", "lot"]
    plots = m.memorial.select(*cols).unionByName(m.register.select(*cols)).unionByName(m.request.select(*cols))
    df = locate.locate_plots(plots, m.plat, m.anchor, m.section, m.cemetery)
    return df.select(*cols, "tier", r2("e"), r2("n"), "acc", "level", "src", "pins", "disputed", r6("lat"), r6("lng"))


oracle("locate_plots", """
  SELECT * REPLACE (round(e, 2) AS e, round(n, 2) AS n, round(lat, 6) AS lat, round(lng, 6) AS lng) FROM o_located""")

# requests
view("o_mem_ros", """
  SELECT * FROM o_best_reg UNION ALL SELECT cem_id, mid, key, 60 FROM o_era_steps WHERE mid is not null""")
view("o_req_unique2", """
  SELECT * FROM o_req_unique u WHERE NOT EXISTS (SELECT 1 FROM o_linked l WHERE l.cem_id = u.cem_id AND l.key = u.key)""")
view("o_rl", """
  SELECT q.cem_id, q.ord, coalesce(b.key, f.key, u.key) AS key, coalesce(b.score, f.score, u.score) AS ros_score,
         case when b.key is not null then 'memorial' when f.key is not null then 'fuzzy' when u.key is not null then 'unique' end AS how
  FROM o_req q LEFT JOIN o_mem_ros b ON q.cem_id = b.cem_id AND q.mid = b.mid LEFT JOIN o_req_fuzzy f ON q.ord = f.ord LEFT JOIN o_req_unique2 u ON q.ord = u.ord""")
_conf = lambda a, b, c: f"(coalesce({a}.{c}, '') <> '' and coalesce({b}.{c}, '') <> '' and {a}.{c} <> {b}.{c})"
view("o_req_plots", f"""
  SELECT q.*, l.key, l.ros_score, l.how, coalesce(l.ros_score BETWEEN 1 AND 84, false) AS ros_verify, l.key is not null and r.section = '' AS ros_no_plot,
         case when r.section <> '' then r.section end AS r_section, case when r.section <> '' then r.sub end AS r_sub,
         case when r.section <> '' then r.block end AS r_block, case when r.section <> '' then r.lot end AS r_lot,
         coalesce(q.section, '') <> '' and coalesce(r.section, '') <> '' and (
           ({_conf('q', 'r', 'section')} and q.section <> '*' and r.section <> '*') or {_conf('q', 'r', 'sub')} or {_conf('q', 'r', 'block')}
           or coalesce(try_cast(nullif(q.lot, '') as double) <> try_cast(nullif(r.lot, '') as double), false)) AS plot_conflict
  FROM o_req q JOIN o_rl l ON q.ord = l.ord LEFT JOIN o_reg r ON r.cem_id = l.cem_id AND r.key = l.key""")


@query("plot_conflict")
def _(t):
    m = model(t)
    return enrich.request_plots(m.request, m.request_links, m.register).select("cem_id", "ord", "key", "plot_conflict", "ros_verify", "ros_no_plot")


oracle("plot_conflict", "SELECT cem_id, ord, key, plot_conflict, ros_verify, ros_no_plot FROM o_req_plots")

_lr = lambda x: (f"coalesce(case {x}.level when 'lot' then 1000 when 'adjacent' then 2000 when 'block' then 3000 when 'section' then 4000 end + {x}.acc, 1000000)")
_lj = lambda a, pre: (f"LEFT JOIN o_located {a} ON {a}.cem_id = q.cem_id AND {a}.section = q.{pre}section AND {a}.sub = coalesce(q.{pre}sub, '') "
                      f"AND {a}.block = coalesce(q.{pre}block, '') AND {a}.lot = coalesce(q.{pre}lot, '')")
view("o_enriched0", f"""
  SELECT q.*, m.mid is not null AS has_mem, m.flags AS m_flags,
         case when {S.hav('q.lat', 'q.lng', 'c.lat', 'c.lng')} BETWEEN 5 AND 800 then 'request' when m.lat is not null then 'memorial'
              when {_lr('lr')} <= {_lr('lp')} then case when lr.level is not null then 'register' end else 'plot' end AS src,
         m.lat AS m_lat, m.lng AS m_lng, lr.lat AS lr_lat, lr.lng AS lr_lng, lr.acc AS lr_acc, lr.level AS lr_level, lr.pins AS lr_pins, lr.disputed AS lr_disputed,
         lp.lat AS lp_lat, lp.lng AS lp_lng, lp.acc AS lp_acc, lp.level AS lp_level, lp.pins AS lp_pins, lp.disputed AS lp_disputed
  FROM o_req_plots q JOIN fx_cemetery c ON c.cem_id = q.cem_id LEFT JOIN o_mem_at m ON m.cem_id = q.cem_id AND m.mid = q.mid
  {_lj('lr', 'r_')} {_lj('lp', '')}""")
view("o_fam_name", f"""
  SELECT cem_id, ord, mid, min(pos) AS pos, kin FROM (
    SELECT cem_id, ord, mid, pos, {S.norm('f')} AS kin FROM (SELECT cem_id, ord, mid, unnest(string_split(fam, '|')) AS f, generate_subscripts(string_split(fam, '|'), 1) AS pos FROM o_mem WHERE fam <> ''))
  WHERE kin <> '' GROUP BY cem_id, ord, mid, kin""")
view("o_mem_name", f"SELECT *, {S.norm('name')} AS kin FROM o_mem_at")
view("o_kin_edge", """
  SELECT a.cem_id, a.mid, b.mid AS k_mid, 0 AS dir, a.pos, b.ord AS k_ord, a.kin FROM o_fam_name a JOIN o_mem_name b ON a.cem_id = b.cem_id AND a.kin = b.kin WHERE a.mid <> b.mid
  UNION ALL SELECT b.cem_id, b.mid, a.mid, 1, 0, a.ord, a.kin FROM o_fam_name a JOIN o_mem_name b ON a.cem_id = b.cem_id AND a.kin = b.kin WHERE a.mid <> b.mid""")
view("o_mem_place", """
  SELECT m.*, case when m.lat is not null then m.lat else l.lat end AS at_lat, case when m.lat is not null then m.lng else l.lng end AS at_lng,
         case when m.lat is not null then 8 else l.acc end AS at_acc, case when m.lat is not null then 'gps' else l.level end AS at_level
  FROM o_mem_at m LEFT JOIN o_located l ON l.cem_id = m.cem_id AND l.section = m.section AND l.sub = coalesce(m.sub, '') AND l.block = coalesce(m.block, '') AND l.lot = coalesce(m.lot, '')""")
view("o_relative", """
  SELECT e.cem_id, e.mid, arg_min(p, (p.at_acc, e.dir, e.pos, e.k_ord)) AS k FROM o_kin_edge e JOIN o_mem_place p ON p.cem_id = e.cem_id AND p.mid = e.k_mid
  WHERE p.at_level IN ('gps', 'lot', 'adjacent') GROUP BY e.cem_id, e.mid""")
_src = lambda q, m, r, p: f"case e.src when 'request' then {q} when 'memorial' then {m} when 'register' then {r} when 'plot' then {p} end"
_best = lambda c: (f"case when use_ = 'r' then e.r_{c} when use_ = 'p' then e.{c} when fam_ then k.{c} end")
view("o_enriched", f"""
  SELECT e.cem_id, e.ord, e.prid, e.mid, e.name, e.fn, e.ln, e."by", e.dy, e.plot, e.claimed, e.problem, e.created, e.key, e.ros_score, e.how, e.ros_verify, e.ros_no_plot, e.plot_conflict,
         e.r_section, e.r_sub, e.r_block, e.r_lot, {_best('section')} AS b_section, {_best('sub')} AS b_sub, {_best('block')} AS b_block, {_best('lot')} AS b_lot,
         case when fam_ then k.at_lat else {_src('e.lat', 'e.m_lat', 'e.lr_lat', 'e.lp_lat')} end AS lat,
         case when fam_ then k.at_lng else {_src('e.lng', 'e.m_lng', 'e.lr_lng', 'e.lp_lng')} end AS lng,
         case when fam_ then greatest(10, k.at_acc + 4) else {_src('8', '8', 'e.lr_acc', 'e.lp_acc')} end AS acc,
         case when fam_ then 'family' else {_src("'gps'", "'gps'", 'e.lr_level', 'e.lp_level')} end AS level,
         {_src('null', 'null', 'e.lr_pins', 'e.lp_pins')} AS pins, coalesce({_src('null', 'null', 'e.lr_disputed', 'e.lp_disputed')}, false) AS disputed,
         case when fam_ then k.name end AS via, e.m_flags & 4 <> 0 AS veteran
  FROM (SELECT e.*, r.k, e.src is null and e.has_mem and r.k is not null AS fam_,
               case when e.src in ('request', 'memorial', 'register') then case when coalesce(e.r_section, '') <> '' then 'r' when coalesce(e.section, '') <> '' then 'p' end
                    else case when coalesce(e.section, '') <> '' then 'p' when coalesce(e.r_section, '') <> '' then 'r' end end AS use_
        FROM o_enriched0 e LEFT JOIN o_relative r ON r.cem_id = e.cem_id AND r.mid = e.mid) e""")

ENRICHED = ["cem_id", "ord", "mid", "key", "ros_score", "how", "ros_verify", "ros_no_plot", "plot_conflict", "b_section", "b_sub", "b_block", "b_lot",
            "acc", "level", "pins", "disputed", "via", "veteran"]


@query("enrich_requests")
def _(t):
    return model(t, fresh=True).enriched.select(*ENRICHED, r6("lat"), r6("lng"))


oracle("enrich_requests", f"SELECT {', '.join(ENRICHED)}, round(lat, 6) AS lat, round(lng, 6) AS lng FROM o_enriched")
