"""Registered queries: standardisation and enrichment jobs."""

from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.catalog import sqltext as S
from plotlink.catalog.registry import oracle, query, view
from plotlink.operators import standardize as std

KEYS = ["last", "first", "nl", "sx", "nm", "cf", "fr", "sk"]
PLOT = ["section", "sub", "block", "lot", "grave"]

view("o_nick", S.NICK)
view("o_mem", f"SELECT *, false AS dyb FROM ({S.parse_plot('o_mem_named', 'plot')}) p")
view("o_mem_named", S.name_keys("fx_memorial", "s.name", "s.maiden"))
view("o_reg_years", f"""
  SELECT z.*, {S.year('bd')} AS by, case when {S.year('dd')} <> 0 then {S.year('dd')} else {S.year('burial')} end AS dy,
         ({S.year('dd')} = 0 and {S.year('burial')} <> 0) AS dyb FROM fx_register z""")
view("o_reg_named", S.name_keys("o_reg_years", "s.name", "s.former"))
view("o_reg", f"""
  SELECT cem_id, ord, key, name, sex, bd, dd, burial, "by", dy, dyb, status, flags, note, former, last, first, nl, sx, fr, cf, sk, grave,
         case when coalesce(former, '') = '' then '' else {S.norm(f"coalesce(nullif({S.last('former')}, ''), former)")} end AS nm,
         {S.block('block')} AS block, lot, sub,
         case when {S.has('section', '^[0-9]+$')} then 'Section ' || {S.strip0('section')}
              when section = '' and (block <> '' or lot <> '') then '*' else section end AS section
  FROM o_reg_named""")
view("o_req", f"""
  SELECT p.* FROM ({S.parse_plot('o_req_named', 'plot')}) p""")
view("o_req_named", f"""
  SELECT z.* EXCLUDE (fr0), fr0 AS fr, coalesce(n.canon, fr0) AS cf FROM (
    SELECT r.* REPLACE (coalesce("by", 0) AS "by", coalesce(dy, 0) AS dy), {S.norm('ln')} AS nl, {S.soundex(S.norm('ln'))} AS sx, '' AS nm,
           split_part({S.norm('fn')}, ' ', 1) AS fr0, false AS dyb FROM fx_request r) z LEFT JOIN o_nick n ON z.fr0 = n.nick""")


@query("standardize_names")
def _(t):
    mem = std.standardize_names(t.memorial, "name", "maiden").select(F.lit("mem").alias("kind"), "ord", *KEYS)
    reg = std.standardize_names(t.register, "name").select(F.lit("ros").alias("kind"), "ord", *KEYS)
    return mem.unionByName(reg)


view("o_reg_plain", S.name_keys("fx_register", "s.name", None))
oracle("standardize_names", f"""
  SELECT 'mem' AS kind, ord, {', '.join(KEYS)} FROM o_mem_named
  UNION ALL SELECT 'ros', ord, {', '.join(KEYS)} FROM o_reg_plain""")


@query("extract_years")
def _(t):
    return std.extract_years(t.register).select("cem_id", "key", "by", "dy", "dyb")


oracle("extract_years", 'SELECT cem_id, key, "by", dy, dyb FROM o_reg_years')


@query("standardize_plots")
def _(t):
    return std.standardize_plots(t.memorial).select("cem_id", "mid", *PLOT)


oracle("standardize_plots", f"SELECT cem_id, mid, {', '.join(PLOT)} FROM o_mem")


@query("standardize_plots_counts")
def _(t):
    return std.plot_parse_counts(t.memorial)


oracle("standardize_plots_counts", """
  SELECT cem_id, count(*) AS n_rows, count_if(plot <> '') AS n_text, count_if(section is not null) AS n_parsed,
         count_if(plot <> '' and section is null) AS n_unparsed FROM o_mem GROUP BY cem_id""")

view("fx_alias_plot", """
  SELECT cem_id, k AS ord,
         split_part('Hoffstetter Hill,Sqare Hill,Section 11,Round Hill,NorthHill,Culter hill,Sub 6,Morris Hill,Veterans Hill,Mausoleum,Singles Sec,Old Part,Old part sec 3,Sub 4,Subdiv 7,By oak hill,Maple Grove,Unknown plot', ',', cast(k % 18 + 1 as int))
         || case k % 5 when 0 then ' Blk ' || blk when 1 then ' Row 0' || cast(lot % 7 as string) when 2 then ' Sub: ' || cast(lot as string) else '' end
         || case when k % 7 = 0 then '' else ', Lot: #' || cast(lot as string) || case when k % 3 = 0 then 'A' else '' end end
         || case when k % 4 = 0 then '' else ' (Grave ' || cast(grave as string) || ')' end AS plot
  FROM fx_base""")


@query("standardize_plots_aliased")
def _(t):
    return std.standardize_plots_aliased(t.alias_plot).select("ord", "plot", *PLOT)


_cleaned = f"trim({S.rep(S.rep('plot', '[().,]', ' '), r'\s+', ' ')})"
_alias = " ".join(f"when {S.has('s_', p)} then '{n}'" for p, n in C.SECTION_ALIASES)
oracle("standardize_plots_aliased", f"""
  SELECT ord, plot, section,
         case when section is not null then case when moved then blk0 when open_sub then txt else sub0 end end AS sub,
         case when section is not null then case when moved then '' else blk0 end end AS block,
         case when section is not null then {S.canonical_lot(S.rx('s_', C.ALIASED_LOT))} end AS lot,
         case when section is not null then {S.rx('s_', C.ALIASED_GRAVE)} end AS grave
  FROM (SELECT *, (section = 'Old Part' and sub0 = '') AS open_sub,
               coalesce(section = 'Old Part' and sub0 = '' and txt = '' and {S.has('blk0', '^[1-5]$')}, false) AS moved
    FROM (SELECT *, case when s_ = '' or {S.has('s_', C.PLOT_JUNK)} then null {_alias} end AS section,
                 {S.rx('s_', C.ALIASED_SUB)} AS sub0, {S.block(S.rx('s_', C.ALIASED_BLOCK))} AS blk0, {S.rx('s_', C.SUB_FROM_TEXT)} AS txt
      FROM (SELECT *, {_cleaned} AS s_ FROM fx_alias_plot)))""")

view("fx_code", """
  SELECT k AS ord,
         case when k % 10 = 9 then 'no code ' || cast(k as string)
              else case when k % 2 = 0 then 'OakGrove' else 'RIVERSIDE' end || '-'
                   || case when k % 3 = 0 then lpad(cast(q % 27 + 1 as string), 2, '0') when k % 3 = 1 then '0' || lpad(cast(q % 27 + 1 as string), 2, '0') else cast(q % 27 + 1 as string) end
                   || '-' || case when k % 7 = 0 then '' when k % 5 = 0 then '0' || cast(grave as string) else blk end
                   || '-' || lpad(cast(lot as string), 3, '0') || '-' || case when k % 6 = 0 then '' else cast(grave as string) end end AS code
  FROM fx_base""")


@query("decode_plot_codes")
def _(t):
    return std.decode_plot_codes(t.code).select("ord", "code", *PLOT)


_codes = ",".join(f"('{int(c)}','{s}','{u}')" for c, (s, u) in C.SECTION_CODES.items())
oracle("decode_plot_codes", f"""
  SELECT c.ord, c.code,
         case when ok then coalesce(t.sec, 'Section ' || {S.strip0('n')}) end AS section,
         case when ok then coalesce(t.sub, '') end AS sub, case when ok then {S.block('b')} end AS block,
         case when ok then {S.strip0('l')} end AS lot, case when ok then g end AS grave
  FROM (SELECT *, {S.has('code', C.PLOT_CODE)} AS ok, {S.rx('code', C.PLOT_CODE, 2)} AS n, {S.rx('code', C.PLOT_CODE, 3)} AS b,
               {S.rx('code', C.PLOT_CODE, 4)} AS l, {S.rx('code', C.PLOT_CODE, 5)} AS g,
               upper({S.rx('code', C.PLOT_CODE, 1)}) = 'OAKGROVE' AS coded FROM fx_code) c
  LEFT JOIN (VALUES {_codes}) t(code, sec, sub)
    ON c.ok AND c.coded AND (c.n = t.code OR c.n = '0' || t.code OR (length(t.code) = 1 AND c.n = '00' || t.code))""")


@query("plot_keys")
def _(t):
    cols = ["cem_id", "id", "section", "sub", "block", "lot", "lot_key", "lot_n", "group_sub", "group_block"]
    mem = std.memorial_table(t.memorial).filter("section IS NOT NULL").withColumn("id", F.concat(F.lit("m"), "mid"))
    reg = std.register_table(t.register).filter("section <> ''").withColumn("id", F.concat(F.lit("r"), "key"))
    return std.plot_keys(mem).select(*cols).unionByName(std.plot_keys(reg).select(*cols))


view("o_plotted", """
  SELECT cem_id, 'm' || mid AS id, section, sub, block, lot, grave FROM o_mem WHERE section is not null
  UNION ALL SELECT cem_id, 'r' || key, section, sub, block, lot, grave FROM o_reg WHERE section <> ''""")
_lots = "section in ('Old Part', 'Oak Hill')"
oracle("plot_keys", f"""
  SELECT cem_id, id, section, coalesce(sub, '') AS sub, {S.block('block')} AS block, lot, {S.lot_key('lot')} AS lot_key,
         {S.int_prefix('lot')} AS lot_n, case when {_lots} then coalesce(sub, '') else '' end AS group_sub,
         case when {_lots} then '' else {S.block('block')} end AS group_block FROM o_plotted""")


@query("clean_pins")
def _(t):
    pins = std.clean_pins(t.memorial, t.cemetery)
    return pins.select("cem_id", "mid", "reason", "pin_lat", "pin_lng",
                       F.round("e", 2).alias("e"), F.round("n", 2).alias("n"))


view("o_pins", f"""
  SELECT cem_id, mid, reason, case when reason = 'ok' then lat end AS pin_lat, case when reason = 'ok' then lng end AS pin_lng,
         case when reason = 'ok' then {S.east('lng', 'clat', 'clng')} end AS e, case when reason = 'ok' then {S.north('lat', 'clat')} end AS n
  FROM (SELECT *, case when d is null then 'none' when d < 5 then 'centroid' when d > 800 then 'off_site' else 'ok' end AS reason
        FROM (SELECT m.*, c.lat AS clat, c.lng AS clng, {S.hav('m.lat', 'm.lng', 'c.lat', 'c.lng')} AS d
              FROM fx_memorial m JOIN fx_cemetery c USING (cem_id)))""")
oracle("clean_pins", "SELECT cem_id, mid, reason, pin_lat, pin_lng, round(e, 2) AS e, round(n, 2) AS n FROM o_pins")


@query("approach_table")
def _(t):
    pins = std.clean_pins(t.memorial, t.cemetery).filter("reason = 'ok'").withColumn("acc", F.lit(8))
    rows = std.approach_table(t.observer, pins.select("cem_id", "mid", "lat", "lng", "acc"))
    return rows.select("observer_id", "mid", F.round("dist_m", 2).alias("dist_m"), F.round("bearing", 4).alias("bearing"),
                       "point", "inside", "label")


_p1, _p2, _dl = "radians(o.lat)", "radians(p.pin_lat)", "radians(p.pin_lng - o.lng)"
_bear = (f"((degrees(atan2(sin({_dl}) * cos({_p2}), cos({_p1}) * sin({_p2}) - sin({_p1}) * cos({_p2}) * cos({_dl}))) + 360.0::double) % 360.0::double)")
view("o_approach", f"""
  SELECT o.observer_id, o.mid, {S.hav('o.lat', 'o.lng', 'p.pin_lat', 'p.pin_lng')} AS d, {_bear} AS b
  FROM fx_observer o JOIN o_pins p ON o.cem_id = p.cem_id AND o.mid = p.mid WHERE p.reason = 'ok'""")
oracle("approach_table", f"""
  SELECT observer_id, mid, round(d, 2) AS dist_m, round(b, 4) AS bearing,
         split_part('{','.join(C.COMPASS)}', ',', cast(floor(b / 22.5 + 0.5) as int) % 16 + 1) AS point, d <= 8 AS inside,
         case when d * 3.28084::double < 1000 then cast(cast(floor(d * 3.28084::double + 0.5) as bigint) as varchar) || ' ft'
              when d / 1609.344::double < 2 then printf('%.2f', d / 1609.344::double) || ' mi'
              else printf('%.1f', d / 1609.344::double) || ' mi' end AS label FROM o_approach""")


@query("project_plats")
def _(t):
    df = std.project_plats(t.plat_map, t.plat_entry, t.cemetery)
    return df.select("map_id", "ord", "block", "lot", F.round("e", 2).alias("e"), F.round("n", 2).alias("n"),
                     F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


view("o_plat", f"""
  SELECT p.map_id, p.ord, p.cem_id, m.map_ord, m.section, m.sub, m.style, m.quality, m.loo_median, p.block, p.lot, p.x, p.y,
         m.a * p.x + m.b * p.y + m.c AS e, m.d * p.x + m.f * p.y + m.g AS n, c.lat AS clat, c.lng AS clng
  FROM fx_plat_entry p JOIN fx_plat_map m USING (map_id) JOIN fx_cemetery c ON c.cem_id = p.cem_id""")
oracle("project_plats", f"""
  SELECT map_id, ord, block, lot, round(e, 2) AS e, round(n, 2) AS n, round({S.to_lat('n', 'clat')}, 6) AS lat,
         round({S.to_lng('e', 'clat', 'clng')}, 6) AS lng FROM o_plat""")

view("fx_tile_cached", """
  SELECT cast(15 as int) AS z, cast(floor((lng + 180) / 360 * 32768) as int) AS x,
         cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793e0) / 2 * 32768) as int) AS y
  FROM fx_cemetery WHERE cem_id % 2 = 0""")


@query("tile_cover")
def _(t):
    pins = std.clean_pins(t.memorial, t.cemetery).filter("reason = 'ok'").select("cem_id", "lat", "lng")
    df = std.tile_cover(t.cemetery, pins, t.tile_cached)
    return df.select("z", "x", "y", *[F.round(c, 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _tx(lng):
    return f"floor(({lng} + 180) / 360 * pow(2.0::double, z))"


def _ty(lat):
    return f"floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2.0::double, z))"


oracle("tile_cover", f"""
  SELECT cast(z as int) AS z, x, y, round(-h + x * s, 3) AS xmin, round(h - y * s - s, 3) AS ymin, round(-h + x * s + s, 3) AS xmax, round(h - y * s, 3) AS ymax
  FROM (SELECT *, pi() * 6378137.0::double AS h, 2 * pi() * 6378137.0::double / pow(2.0::double, z) AS s
    FROM (SELECT DISTINCT z, x, cast(unnest(generate_series(y0, y1)) as int) AS y
      FROM (SELECT z, cast(unnest(generate_series(x0, x1)) as int) AS x, y0, y1
        FROM (SELECT z, cast({_tx('w')} as bigint) AS x0, cast({_tx('e')} as bigint) AS x1, cast({_ty('nn')} as bigint) AS y0, cast({_ty('ss')} as bigint) AS y1
          FROM (SELECT unnest([15, 16, 17, 18, 19]) AS z, * FROM (
            SELECT lat + r / 110540.0::double AS nn, lat - r / 110540.0::double AS ss,
                   lng - r / (111320.0::double * cos(radians(lat))) AS w, lng + r / (111320.0::double * cos(radians(lat))) AS e
            FROM (SELECT *, least(650.0::double, greatest(300.0::double, 250.0::double + sqrt(greatest(interments, 1)) * 6.0::double)) AS r FROM fx_cemetery)
            UNION ALL
            SELECT greatest(c.lat, max(p.pin_lat)) + 120 / 111194::double, least(c.lat, min(p.pin_lat)) - 120 / 111194::double,
                   least(c.lng, min(p.pin_lng)) - 120 / 111194::double / cos(radians(c.lat)), greatest(c.lng, max(p.pin_lng)) + 120 / 111194::double / cos(radians(c.lat))
            FROM fx_cemetery c LEFT JOIN o_pins p ON p.cem_id = c.cem_id AND p.reason = 'ok' GROUP BY c.cem_id, c.lat, c.lng)))))) k WHERE NOT EXISTS (SELECT 1 FROM fx_tile_cached t WHERE t.z = k.z AND t.x = k.x AND t.y = k.y)""")
