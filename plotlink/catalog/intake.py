"""Registered queries: sources, publishing, table maintenance."""

import uuid

from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.catalog import sqltext as S
from plotlink.catalog.registry import model, oracle, query, view
from plotlink.functions.frames import union_all
from plotlink.functions.lineage import shared_root
from plotlink.operators import maintain as mt
from plotlink.plans import publish as pb
from plotlink.sources import feeds, places, registers

# ---- positional rows -----------------------------------------------------------------
view("fx_mem_row", """
  SELECT m.*, b.q, case when b.q % 30 = 11 then null when b.q % 20 = 7 then m.mid - 25 else m.mid end AS mid2 FROM fx_memorial m JOIN fx_base b ON b.k = m.ord""")
view("fx_mem_json", """
  SELECT cem_id, floor(q / 40) AS page, '[' || @JOINED('[' || coalesce(cast(mid2 as string), 'null') || ',"' || name || '","' || maiden || '",' || cast(by as string) || ',' || cast(dy as string)
    || ',"' || plot || '",' || coalesce(cast(lat as string), 'null') || ',' || coalesce(cast(lng as string), 'null') || ',' || cast(flags as string) || ',"' || fam || '"]';q)@ || ']' AS rows
  FROM fx_mem_row GROUP BY cem_id, floor(q / 40)""")


@query("read_memorial_rows")
def _(t):
    return feeds.read_memorial_rows(t.mem_json)


view("o_mem_rows", """
  SELECT cem_id, min(o) AS ord, mid2 AS mid, arg_max(r, o) AS r FROM (
    SELECT *, cast(floor(q / 40) as bigint) * 4294967296 + q % 40 AS o, {name: name, maiden: maiden, byr: "by", dy: dy, plot: plot, lat: lat, lng: lng, flags: flags, fam: fam} AS r
    FROM fx_mem_row WHERE mid2 is not null) GROUP BY cem_id, mid2""")
oracle("read_memorial_rows", """
  SELECT cem_id, ord, mid, r.name AS name, r.maiden AS maiden, r.byr AS "by", r.dy AS dy, r.plot AS plot, r.lat AS lat, r.lng AS lng, r.flags AS flags, r.fam AS fam FROM o_mem_rows""")

view("fx_reg_json", """
  SELECT cem_id, floor(ord / 1000) AS page, '[' || @JOINED('["' || cast(key as string) || '","' || name || '","' || sex || '","' || bd || '","' || dd || '","' || burial || '","' || section || '","'
    || sub || '","' || block || '","' || lot || '","' || grave || '","' || status || '",' || cast(flags as string) || ',"' || note || '","' || former || '"]';ord)@ || ']' AS rows
  FROM fx_register GROUP BY cem_id, floor(ord / 1000)""")


@query("read_register_rows")
def _(t):
    return feeds.read_register_rows(t.reg_json)


oracle("read_register_rows", """
  SELECT cem_id, cast(floor(ord / 1000) as bigint) * 4294967296 + row_number() OVER (PARTITION BY cem_id, floor(ord / 1000) ORDER BY ord) - 1 AS ord, key, name, sex, bd, dd, burial,
         section, sub, block, lot, grave, status, flags, note, former FROM fx_register""")

# ---- request and memorial feeds ----------------------------------------------------------
view("fx_req_json", """
  SELECT cem_id, page, case when page % 3 = 0 then '{"photoRequests":' when page % 3 = 1 then '{"requests":' else '' end || '[' || body || ']' || case when page % 3 = 2 then '' else '}' end AS json FROM (
    SELECT cem_id, floor(ord / 2000) AS page, @JOINED(
      case when ord % 2 = 0 then '{"photoRequestId":' || cast(prid as string) || ',"memorialId":"' || case when ord % 7 = 3 then '' else cast(mid as string) end || '","firstName":"' || fn || '","lastName":"' || ln
             || '","birthYear":' || coalesce(cast(by as string), 'null') || ',"longPlot":"' || plot || '","problemDetails":"' || problem || '","dateClaimed":"' || claimed
             || '","latLonMethod":"' || case when ord % 3 = 0 then 'cemetery' else 'memorial' end || '","latitude":' || coalesce(cast(lat as string), 'null') || ',"longitude":' || coalesce(cast(lng as string), 'null') || '}'
           else '{"prId":' || cast(prid as string) || ',"mid":' || cast(mid as string) || ',"fn":"' || fn || '","ln":"' || ln || '","name":"' || name || '","dy":' || coalesce(cast(dy as string), 'null')
             || ',"plot":"' || plot || '","problem":"' || problem || '","lat":' || coalesce(cast(lat as string), 'null') || ',"lng":' || coalesce(cast(lng as string), 'null') || '}' end;ord)@ AS body
    FROM fx_request GROUP BY cem_id, floor(ord / 2000)) src""")


@query("import_requests_json")
def _(t):
    return feeds.import_requests_json(t.req_json, t.cemetery).select("cem_id", "prid", "mid", "fn", "ln", "name", "by", "dy", "plot", "claimed", "problem", "lat", "lng")


oracle("import_requests_json", f"""
  SELECT q.cem_id, prid, mid, fn, ln, q.name, case when even then "by" end AS "by", case when even then null else dy end AS dy, plot, case when even then claimed else '' end AS claimed,
         left(trim(regexp_replace(problem, '\\s+', ' ', 'g')), 140) AS problem, case when ok then q.lat end AS lat, case when ok then q.lng end AS lng
  FROM (SELECT q.*, q.ord % 2 = 0 AS even, coalesce({S.hav('q.lat', 'q.lng', 'c.lat', 'c.lng')} BETWEEN 5 AND 800, false) and not (q.ord % 2 = 0 and q.ord % 3 = 0) AS ok
        FROM fx_request q JOIN fx_cemetery c USING (cem_id)) q WHERE NOT (even AND ord % 7 = 3)""")


@query("import_requests_sheet")
def _(t):
    q = t.request.select(F.col("mid").cast("string").alias(" MemorialID "), F.col("fn").alias("FirstName"), F.col("ln").alias("lastname"),
                         F.concat(F.lit("abt. "), F.coalesce(F.col("by").cast("string"), F.lit("?"))).alias("birthDate"), F.col("lat").cast("string").alias("LATITUDE"),
                         F.col("lng").cast("string").alias("longitude"), F.col("plot"), F.concat(F.col("dy").cast("string"), F.lit("-05-01")).alias("Deathdate"))
    return feeds.import_requests_sheet(q)


oracle("import_requests_sheet", """
  SELECT mid, fn, ln, fn || ' ' || ln AS name, "by", dy, 'abt. ' || coalesce(cast("by" as varchar), '?') AS bd, coalesce(dy || '-05-01', '') AS dd, plot, '' AS notes, '' AS created, lat, lng FROM fx_request""")

view("fx_memfeed_json", """
  SELECT cem_id, floor(ord / 1000) AS page, '{"records":[' || @JOINED(
    case when ord % 10 = 9 then '[' || cast(mid as string) || ',"' || name || '","' || maiden || '",' || cast(by as string) || ',' || cast(dy as string) || ',"' || plot || '",' || coalesce(cast(lat as string), 'null') || ',' || coalesce(cast(lng as string), 'null') || ',' || cast(flags as string) || ']'
         else '{"memorialId":' || case when ord % 33 = 5 then 'null' else cast(mid as string) end || ',"fullName":"' || name || '","maidenName":"' || maiden || '","birthYear":' || cast(by as string) || ',"deathYear":' || cast(dy as string)
           || ',"plot":" ' || plot || '  x","latitude":' || coalesce(cast(lat as string), 'null') || ',"longitude":' || coalesce(cast(lng as string), 'null')
           || ',"intermentHasPhoto":' || case when ord % 2 = 1 then 'true' else 'false' end || ',"photoRequest":' || case when ord % 3 = 1 then '1' else '0' end || ',"personHasPhoto":' || case when ord % 5 = 1 then 'true' else 'null' end || '}' end;ord)@ || ']}' AS json
  FROM fx_memorial GROUP BY cem_id, floor(ord / 1000)""")


@query("import_memorials_json")
def _(t):
    return feeds.import_memorials_json(t.memfeed_json, t.cemetery).select("cem_id", "mid", "name", "maiden", "by", "dy", "plot", "lat", "lng", "flags")


oracle("import_memorials_json", f"""
  SELECT m.cem_id, m.mid, m.name, m.maiden, m."by", m.dy, case when raw then plot else trim(regexp_replace(' ' || plot || '  x', '\\s+', ' ', 'g')) end AS plot,
         case when raw then m.lat when d BETWEEN 5 AND 500 then round(m.lat, 6) end AS lat, case when raw then m.lng when d BETWEEN 5 AND 500 then round(m.lng, 6) end AS lng,
         case when raw then flags else cast(case when ord % 2 = 1 then 1 else 0 end + case when ord % 3 = 1 then 2 else 0 end + case when ord % 5 = 1 then 8 else 0 end as int) end AS flags
  FROM (SELECT m.*, m.ord % 10 = 9 AS raw, sqrt(pow({S.east('m.lng', 'c.lat', 'c.lng')}, 2) + pow({S.north('m.lat', 'c.lat')}, 2)) AS d FROM fx_memorial m JOIN fx_cemetery c USING (cem_id)) m
  WHERE raw OR ord % 33 <> 5""")

# ---- registers ---------------------------------------------------------------------------
view("fx_reg_sheet", """
  SELECT k AS ord, case when k % 17 = 0 then '' else upper(sur || ', ' || fst) end AS name, case when k % 4 = 1 then 'RIVERSIDE-0' || cast(lot as string) || '-' || blk || '-007-2' else '' end AS code,
         case k % 3 when 0 then '0' || cast(lot as string) when 1 then 'East Side' else 'Sec ' || sec end AS section, lower(blk) AS block, '0' || cast(lot as string) AS lot, cast(grave as string) AS grave,
         cast(by_ as string) AS born FROM fx_base""")


@query("import_register_sheet")
def _(t):
    s = t.reg_sheet.select(F.col("name").alias("Deceased"), F.col("code").alias("Plot Number"), F.col("section").alias(" Section"), F.col("block").alias("BLK"),
                           F.col("lot").alias("Lot"), F.col("grave").alias("Space"), F.col("born").alias("Born"))
    return feeds.import_register_sheet(s)


oracle("import_register_sheet", """
  SELECT name, born AS bd, '' AS dd, '' AS burial,
         case when code <> '' then 'Section ' || lot0 when s % 3 = 0 then 'Section ' || lot0 when s % 3 = 1 then 'East Side' else upper(section) [1:0] || 'Section ' || upper(right(section, 1)) end AS section,
         '' AS sub, upper(block) AS block, case when code <> '' then '7' else lot0 end AS lot, case when code <> '' then '2' else grave end AS grave
  FROM (SELECT *, ord AS s, ltrim(lot, '0') AS lot0 FROM fx_reg_sheet) WHERE name <> ''""")

view("fx_reg_text", """
  SELECT k AS line, case k % 5 when 0 then '   ' when 1 then 'no name here 1901' else upper(substr(sur, 1, 1)) || substr(sur, 2) || ', ' || fst || '  b. ' || cast(1820 + (17 * q) % 110 as string)
           || case when k % 3 = 0 then '' else ' d. ' || cast(1850 + (17 * q) % 110 as string) end
           || case when k % 2 = 0 then '  CITY-0' || cast(grave as string) || '-' || blk || '-0' || cast(lot as string) || '-' || cast(grave as string) else '  Section ' || sec || ' Lot ' || cast(lot as string) end end AS text
  FROM fx_base""")


@query("import_register_text")
def _(t):
    return feeds.import_register_text(t.reg_text)


oracle("import_register_text", """
  SELECT line, name, bd, dd, case when code then 'Section ' || grave else 'Section ' || sec end AS section, '' AS sub, case when code then blk else '' end AS block, cast(lot as varchar) AS lot,
         case when code then cast(grave as varchar) else '' end AS grave
  FROM (SELECT k AS line, upper(sur[1]) || sur[2:] || ', ' || fst AS name, cast(1820 + (17 * q) % 110 as varchar) AS bd, case when k % 3 = 0 then '' else cast(1850 + (17 * q) % 110 as varchar) end AS dd,
               k % 2 = 0 AS code, sec, blk, lot, grave, k % 5 AS m FROM fx_base) WHERE m >= 2""")

_LINK = '<a href="/([^"]*)">([^<]*)</a>'


@query("extract_label_values")
def _(t):
    return registers.extract_label_values(t.raw("pages"), "page_id", "html", _LINK, keep=None)


oracle("extract_label_values", f"""
  SELECT page_id, label, arg_min(case when value = label then '' else value end, pos) AS value FROM (
    SELECT page_id, pos, trim(l) AS label, trim(replace(replace(regexp_replace(v, '&nbsp;?', ' ', 'g'), '&amp;', '&'), '&#39;', '''')) AS value FROM (
      SELECT page_id, unnest(regexp_extract_all(html, {S.q(_LINK)}, 1)) AS l, unnest(regexp_extract_all(html, {S.q(_LINK)}, 2)) AS v,
             unnest(generate_series(1, len(regexp_extract_all(html, {S.q(_LINK)}, 1)))) AS pos FROM pages)) WHERE label <> '' GROUP BY ALL""")

_PARA, _NAME = r"(?s)<p>.*?</p>", r"^(\S+) (\S+) (.*)$"


@query("extract_record_entries")
def _(t):
    df = registers.extract_record_entries(t.raw("pages"), "page_id", "html", _PARA, _NAME)
    return df.select("page_id", "pos", "last", "first", "bd", "dd", "burial", "flags", "section", "lot")


view("o_entry", f"""
  SELECT page_id, pos, upper(replace({S.rx('x', _NAME)}, 'ß', 'ss')) AS last, upper(replace({S.rx('x', _NAME, 2)}, 'ß', 'ss')) AS first, {S.rx('x', _NAME, 3)} AS r FROM (
    SELECT page_id, pos, trim(regexp_replace(regexp_replace(b, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS x FROM (
      SELECT page_id, unnest(regexp_extract_all(html, {S.q(_PARA)})) AS b, unnest(generate_series(0, len(regexp_extract_all(html, {S.q(_PARA)})) - 1)) AS pos FROM pages)) WHERE {S.has('x', _NAME)}""")
view("o_entry_plot", f"SELECT *, {S.rx('r', r'Plot:\s*(.+)$')} AS plot FROM o_entry")
oracle("extract_record_entries", f"""
  SELECT page_id, cast(pos as int) AS pos, last, first, {S.rx('r', r'\bb\.\s*([0-9/]+)')} AS bd, {S.rx('r', r'\bd\.\s*([0-9/]+)')} AS dd, {S.rx('r', r'\bbur\.\s*([0-9/]+)')} AS burial,
         case when {S.has('r', r'(?i)\bVeteran\b')} then 4 else 0 end AS flags, section, lot FROM ({S.parse_plot('o_entry_plot', 'plot')})""")

view("fx_record", """
  SELECT cem_id, k AS key, k % 13 = 4 AS miss, case when k % 11 = 2 then '' else ' ' || upper(sur || ', ' || fst) || ' ' end AS name, 'F' AS sex, cast(by_ as string) AS bd, cast(dy_ as string) AS dd, '' AS burial,
         case k % 4 when 0 then '0' || cast(lot as string) when 1 then lpad(cast(q % 27 + 1 as string), 2, '0') when 2 then 'Annex' else '' end AS section,
         case k % 3 when 0 then 'Blck' || blk when 1 then ' block ' || blk else lower(blk) end AS block, '00' || cast(lot as string) AS lot, '0' || cast(grave as string) AS plot, 'Sold' AS status,
         case when k % 5 = 0 then 'Yes' else 'no' end AS veteran, case when k % 2 = 0 then 'see  card' end AS user3, case when k % 3 = 0 then 'moved from old part' else '' end AS notes,
         case when k % 7 = 0 then 'child' end AS head, case when k % 9 = 0 then 'urn' end AS foot, case when k % 6 = 0 then 'Smith & Sons ' || split_part('a,bbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb', ',', cast(k % 2 + 1 as int)) end AS funeral_home,
         '' AS former FROM fx_base""")


@query("flatten_register_records")
def _(t):
    r = t.record
    return registers.flatten_register_records(r.filter("cem_id % 2 = 0"), True).unionByName(registers.flatten_register_records(r.filter("cem_id % 2 = 1"), False))


_codes2 = ",".join(f"('{c}','{s}','{u}')" for c, (s, u) in C.SECTION_CODES.items())
oracle("flatten_register_records", f"""
  SELECT r.cem_id, r.key, trim(name) AS name, sex, bd, dd, burial,
         case when cem_id % 2 = 0 then coalesce(t.sec, section) when {S.has('section', '^[0-9]+$')} and ltrim(section, '0') <> '' then 'Section ' || ltrim(section, '0') else section end AS section,
         case when cem_id % 2 = 0 then coalesce(t.sub, '') else '' end AS sub, {S.rep("upper(trim(block))", r"^(?:BLOCK|BLCK|BLK)\s*", "", False)} AS block, {S.strip0('lot')} AS lot, {S.strip0('plot')} AS grave, status,
         case when veteran = 'Yes' then 4 else 0 end AS flags,
         left(trim(regexp_replace(concat_ws(' | ', user3, nullif(notes, ''), 'head: ' || head, 'foot: ' || foot, 'funeral home: ' || funeral_home), '\\s+', ' ', 'g')), 160) AS note, former
  FROM fx_record r LEFT JOIN (VALUES {_codes2}) t(code, sec, sub) ON t.code = r.section WHERE NOT miss AND name <> ''""")

view("fx_position_code", """
  SELECT k AS ord, split_part('Pritchard,Elm Hall,St. Patricks-Irishtown,Riverdale,Seville - French,Brady,Sibley-Welch,Nowhere', ',', cast(k % 8 + 1 as int)) AS grammar,
         case k % 8 when 3 then case when q % 2 = 0 then 'R 0' || cast(lot as string) || '-' || cast(grave as string) else 'R-' || cast(lot as string) end
                    when 4 then 'SC 0' || cast(lot as string) || case when q % 3 = 0 then '' else '-0' || cast(grave as string) end
                    when 5 then case when q % 7 = 0 then 'B?' else 'B' || cast(lot as string) || '-' || cast(grave as string) end
                    when 6 then case when q % 2 = 0 then 'S Col ' || cast(grave as string) || ' ' || blk else ' S0' || cast(lot as string) end else '' end AS plot,
         case k % 8 when 0 then 's' || cast(grave as string) || '-R0' || cast(lot as string) || '-' || cast(q % 50 as string) || case when q % 5 = 0 then 'a' else '' end
                    when 1 then case when q % 6 = 0 then 'x' else '0' || cast(grave as string) || '-' || cast(lot as string) || '-' || cast(q % 40 as string) end
                    when 2 then case when q % 2 = 0 then '02-cz-0' || cast(lot as string) else '2-0' || cast(lot as string) || '-1' end else '' end AS mapno,
         q, lot, grave, blk FROM fx_base""")


@query("decode_position_codes")
def _(t):
    return registers.decode_position_codes(t.position_code).select("ord", "grammar", "section", "block", "lot", "grave")


view("o_position", """
  SELECT ord, grammar,
    case k when 0 then 'Section ' || grave when 1 then case when q % 6 <> 0 then 'Section ' || grave end when 2 then 'Section 2' when 5 then case when q % 7 <> 0 then '*' end when 7 then null else '*' end AS section,
    case k when 0 then cast(lot as varchar) when 1 then case when q % 6 <> 0 then cast(lot as varchar) end when 2 then case when q % 2 = 0 then 'CZ' else cast(lot as varchar) end
           when 5 then case when q % 7 <> 0 then '' end when 6 then case when q % 2 = 0 then 'COL' || grave else '' end when 7 then null else '' end AS block,
    case k when 0 then cast(q % 50 as varchar) when 1 then case when q % 6 <> 0 then cast(q % 40 as varchar) end when 2 then case when q % 2 = 0 then cast(lot as varchar) else '1' end
           when 5 then case when q % 7 <> 0 then cast(lot as varchar) end when 6 then case when q % 2 = 0 then blk else cast(lot as varchar) end when 7 then null else cast(lot as varchar) end AS lot,
    case k when 3 then case when q % 2 = 0 then cast(grave as varchar) else '' end when 4 then case when q % 3 = 0 then '' else cast(grave as varchar) end
           when 5 then case when q % 7 <> 0 then cast(grave as varchar) end when 1 then case when q % 6 <> 0 then '' end when 7 then null else '' end AS grave
  FROM (SELECT *, ord % 8 AS k FROM fx_position_code)""")
oracle("decode_position_codes", "SELECT * FROM o_position")


@query("position_share")
def _(t):
    return registers.position_share(registers.decode_position_codes(t.position_code))


oracle("position_share", """
  SELECT grammar, count(*) AS n, count(section) AS n_located, cast(floor(100 * count(section) / count(*) + 0.5) as int) AS located_pct FROM o_position GROUP BY grammar""")


@query("walk_order_transcript")
def _(t):
    return registers.walk_order_transcript(t.line)


view("o_line", """
  SELECT *, sum(case when is_sec then 1 else 0 end) OVER w AS sn, sum(case when is_sec or is_row then 1 else 0 end) OVER w AS rn FROM (
    SELECT *, text like 'SECTION%' AS is_sec, text like 'Row%' AS is_row, text like '%, %' AS is_name FROM fx_line) WINDOW w AS (PARTITION BY file ORDER BY line)""")
oracle("walk_order_transcript", """
  SELECT file, line, upper(regexp_extract(text, '^(.*?)\\s+[0-9]{4}', 1)) AS name, case when len(ys) >= 2 then ys[1] else '' end AS bd, ys[-1] AS dd,
         'Section ' || list_position(['one', 'two', 'three'], sec) AS section, cast(list_position(['one', 'two', 'three', 'four', 'five'], row) as varchar) AS block, cast(pos as varchar) AS lot,
         case when text like '%(burial%' then 'burial Apr. 25' else '' end AS note
  FROM (SELECT *, row_number() OVER (PARTITION BY file, rn ORDER BY line) AS pos FROM (
    SELECT *, regexp_extract_all(text, '[0-9]{4}') AS ys, max(case when is_sec then split_part(text, ' ', 2) end) OVER (PARTITION BY file, sn) AS sec,
           max(case when is_row then split_part(text, ' ', 2) end) OVER (PARTITION BY file, rn) AS row FROM o_line) WHERE is_name AND sec is not null AND row is not null)""")

view("fx_triplet", """
  SELECT cem_id AS file, q AS line, case when q = case when cem_id % 5 = 0 then 199 else max(q) OVER (PARTITION BY cem_id) end then 'Copyright 2020' when q % 4 = 0 then case when q % 8 = 0 then upper(substr(sur, 1, 1)) || substr(sur, 2) || ', ' || fst else upper(sur) end
           when q % 4 = 1 then case when q % 3 = 0 then '[removed]' else lower(blk) end when q % 4 = 2 then cast(lot as string) || ' a' else case when q % 5 = 0 then 'County Ch.' else blk end end AS text FROM fx_base""")


@query("triplet_transcript")
def _(t):
    return registers.triplet_transcript(t.triplet)


oracle("triplet_transcript", """
  SELECT file, cast(rec as bigint) AS rec, max(case when is_name then upper(text) end) AS name, '*' AS section, coalesce(max(case when line = row_at then upper(text) end), '') AS block,
         coalesce(max(case when line = lot_at then regexp_replace(text, '[^0-9]', '', 'g') end), '') AS lot,
         left('sexton record 1941' || coalesce(' · ' || string_agg(text, ' ' ORDER BY line) FILTER (NOT is_name AND line IS DISTINCT FROM row_at AND line IS DISTINCT FROM lot_at), ''), 120) AS note
  FROM (SELECT *, min(case when line > row_at and regexp_matches(text, '^[0-9]') then line end) OVER (PARTITION BY file, rec) AS lot_at FROM (
    SELECT *, min(case when not is_name and regexp_matches(text, '^[A-Za-z]$') then line end) OVER (PARTITION BY file, rec) AS row_at FROM (
      SELECT *, sum(case when is_name then 1 else 0 end) OVER (PARTITION BY file ORDER BY line) AS rec FROM (
        SELECT *, line % 4 = 0 AS is_name FROM (SELECT *, min(case when text like 'Copyright%' then line end) OVER (PARTITION BY file) AS stop FROM fx_triplet) WHERE stop is null or line < stop)))) WHERE rec > 0 GROUP BY file, rec""")

# ---- places ------------------------------------------------------------------------------
view("fx_listing", """
  SELECT k AS ord, cast(k % 5000 as int) AS cem_id, 'Cemetery ' || cast(k % 5000 as string) AS name, 'County ' || cast(cast(floor(k / 4000) as int) as string) AS county,
         case when k % 19 = 3 then null else 43e0 + (k % 701) * 0.001e0 end AS lat, -84e0 - (k % 503) * 0.001e0 AS lng, cast(k % 900 as int) AS interments, cast(case when k % 4 = 0 then 0 else k % 9 end as int) AS photo_requests
  FROM fx_base""")
HOME, PINNED = (43.2, -84.3), [7, 8, 4321]


@query("discover_cemeteries")
def _(t):
    return places.discover_cemeteries(t.listing, HOME, 15, PINNED)


view("o_listing", f"""
  SELECT *, round({S.hav(f'{HOME[0]}::double', f'({HOME[1]})::double', 'lat', 'lng', '3958.8::double')}, 1) AS miles FROM (
    SELECT *, row_number() OVER (PARTITION BY cem_id ORDER BY ord) AS rn FROM fx_listing WHERE lat is not null) WHERE rn = 1""")
oracle("discover_cemeteries", """
  SELECT cem_id, name, county, lat, lng, interments, photo_requests, miles FROM o_listing WHERE cem_id IN (7, 8, 4321) OR (miles <= 15 AND photo_requests > 0)""")

# outlines, a few ways of vertices per cemetery, and lone points as gates
view("fx_element", """
  SELECT cem_id, cast(poly as bigint) AS el_id, 'way' AS type, case when poly = 0 then 'cemetery' end AS landuse, case when poly = 1 then 'grave_yard' end AS amenity, cast(null as string) AS highway, v, lat, lng FROM fx_ground_vertex
  UNION ALL SELECT b.cem_id, 100 + cast(floor(b.q / 6) as bigint), 'way', null, null, 'service', cast(b.q % 6 as int), c.lat + (20 + (b.q * 37) % 900) / 111195e0, c.lng + ((b.q * 53) % 400 - 200) / 81000e0
    FROM fx_base b JOIN fx_cemetery c USING (cem_id) WHERE b.k % 2 = 0
  UNION ALL SELECT b.cem_id, 1000000 + b.k, 'node', null, null, null, 0, c.lat + ((b.q * 41) % 1000 - 300) / 111195e0, c.lng + ((b.q * 29) % 600 - 300) / 81000e0
    FROM fx_base b JOIN fx_cemetery c USING (cem_id) WHERE b.k % 2 = 1""")


@query("classify_grounds")
def _(t):
    return places.classify_grounds(t.element, t.cemetery)


view("o_touch", """
  SELECT p.cem_id, p.el_id, p.v, p.type, bool_or(coalesce(near, false) or coalesce(inside, false)) AS touch FROM fx_element p LEFT JOIN (
    SELECT p.cem_id, p.el_id, p.v, e.poly, count_if(((e.xi > p.lng) <> (e.xj > p.lng)) AND p.lat < (e.yj - e.yi) * (p.lng - e.xi) / nullif(e.xj - e.xi, 0) + e.yi) % 2 = 1 AS inside,
           bool_or(abs(e.yi - p.lat) < 0.0006 AND abs(e.xi - p.lng) < 0.0006) AS near
    FROM fx_element p JOIN o_edge e USING (cem_id) GROUP BY ALL
    UNION ALL SELECT p.cem_id, p.el_id, p.v, -1, false, abs(c.lat - p.lat) < 0.0006 AND abs(c.lng - p.lng) < 0.0006 FROM fx_element p JOIN fx_cemetery c USING (cem_id) WHERE p.cem_id % 6 = 0) h
  USING (cem_id, el_id, v) WHERE p.landuse is null AND p.amenity is null GROUP BY ALL""")
oracle("classify_grounds", """
  SELECT cem_id, 'bound' AS kind, el_id, count(*) AS n_points FROM fx_element WHERE landuse is not null OR amenity is not null GROUP BY ALL
  UNION ALL SELECT cem_id, 'drive', el_id, count(*) FROM o_touch WHERE type = 'way' GROUP BY ALL HAVING count_if(touch) >= greatest(2, count(*) * 0.4)
  UNION ALL SELECT o.cem_id, 'gate', o.el_id, 1 FROM o_touch o JOIN fx_element p USING (cem_id, el_id, v) JOIN fx_cemetery c USING (cem_id)
    WHERE o.type = 'node' AND case when o.cem_id % 6 <> 0 then o.touch else abs(p.lat - c.lat) + abs(p.lng - c.lng) < 0.004 end""")

view("fx_cell", """
  SELECT 'Sheet ' || cast(cem_id as string) AS sheet, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(q % 26 + 1 as int), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(floor(q / 26) % 26 + 1 as int), 1) || cast(q % 90 + 1 as string) AS ref,
         case q % 7 when 0 then 'Drive' when 1 then ' 0' || cast(lot as string) || ' ' when 2 then cast(lot as string) || 'A' when 3 then '000' when 4 then cast(10000 + q as string) else cast(lot * 7 as string) end AS value,
         cast(q % 26 + 1 as int) AS c1, cast(floor(q / 26) % 26 + 1 as int) AS c2, cast(q % 90 + 1 as int) AS r, q, lot FROM fx_base""")


@query("grid_cells_to_lots")
def _(t):
    return places.grid_cells_to_lots(t.cell)


oracle("grid_cells_to_lots", """
  SELECT sheet, case when q % 7 = 3 then '0' when q % 7 in (1, 2) then cast(lot as varchar) else cast(lot * 7 as varchar) end AS lot, case when q % 7 = 2 then 'A' else '' end AS suffix, c1 * 26 + c2 AS col, r AS row,
         count(*) OVER (PARTITION BY sheet) AS n_sheet FROM fx_cell WHERE q % 7 not in (0, 4)""")

view("fx_photo_file", """
  SELECT case event_id % 4 when 0 then cast(user_id as string) || '.jpg' when 1 then 'ros_' || cast(user_id as string) || '-' || cast(event_id % 99 + 1 as string) || '.jpg' when 2 then cast(user_id as string) || '.thumb.jpg' else 'note.txt' end AS file,
         cast(floor(@EPOCH_US(ts)@ / 1000e0) as bigint) AS ts, cast(floor(value * 1000) as bigint) AS size FROM events""")


@query("photo_inventory")
def _(t):
    return places.photo_inventory(t.photo_file)


oracle("photo_inventory", """
  SELECT replace(regexp_replace(replace(file, '.jpg', ''), '-[0-9]+$', ''), 'ros_', 'ros:') AS pk, coalesce(try_cast(nullif(regexp_extract(file, '-([0-9]+)[.]', 1), '') as int), 0) AS slot, ts, size
  FROM fx_photo_file WHERE file like '%.jpg' AND file not like '%thumb%'""")

# ---- publishing --------------------------------------------------------------------------


view("fx_cemetery_page", """
  SELECT c.*, cast(cem_id as double) / 4 AS miles, -6.5e0 - cem_id / 100e0 AS declination, case when cem_id % 4 = 0 then 'office ' || cast(cem_id as string) else '' end AS contact,
         case when cem_id % 2 = 0 then '2024-04-01' else '' end AS as_of FROM fx_cemetery c""")
view("fx_drive_vertex", "SELECT cem_id, poly, v, lat + 0.0001e0 AS lat, lng - 0.0002e0 AS lng FROM fx_ground_vertex WHERE v < 3 AND cem_id % 4 <> 1")
view("fx_gate", "SELECT cem_id, v AS gate, lat, lng FROM fx_ground_vertex WHERE poly = 0 AND cem_id % 3 = 1")
BUNDLE = {"cemetery": "cemetery_page", "section": "section_given", "plat_map": "plat_map", "plat_entry": "plat_entry", "ground_vertex": "ground_vertex", "drive_vertex": "drive_vertex", "gate": "gate",
          "request": "request", "memorial": "memorial", "register": "register"}


def _bundle(t):
    tables = {name: getattr(t, of) for name, of in BUNDLE.items()}
    blocks = F.when(F.col("cem_id") % 5 == 2, F.array(F.lit("A"), F.lit("C"))).otherwise(F.array().cast("array<string>"))
    return {**tables, "cemetery": tables["cemetery"].withColumn("sg_blocks", blocks)}


#: Pages are small here, so that most cemeteries have many.
_PAGE = 40


def _published(t, page_rows=_PAGE):
    docs = pb.publish_bundle(_bundle(t), "2024-05-01", (43.4, -84.6), 60.0, page_rows)
    path = f"{shared_root(t.spark)}/bundle-{uuid.uuid4().hex}"
    pb.write_bundle(docs, path)
    return path


@query("publish_bundle")
def _(t):
    """Every line as it was written: what it is a page of, its rows one by one."""
    lines = t.spark.read.schema("v int, page int, generated string, home struct<lat:double,lng:double>, radiusMiles double, cemeteries array<struct<id:bigint,first:bigint,name:string,contact:string,"
                                "manifest:map<string,struct<n:bigint,pages:bigint>>,requests:array<struct<prId:bigint,mid:bigint,ln:string,plot:string>>,memorials:array<array<string>>,roster:array<array<string>>,"
                                "maps:array<struct<ord:int,section:string,entries:array<array<string>>>>>>").json(_published(t))
    c = lines.select("page", "generated", "radiusMiles", F.inline("cemeteries")).withColumn("cem_id", F.col("id").cast("int"))
    row = lambda kind, pos, text: (F.lit(kind).alias("kind"), "cem_id", "page", pos.cast("bigint").alias("pos"), text.alias("row"))
    listed = lambda field, kind, text: c.select("cem_id", "page", "first", F.posexplode(field).alias("p", "x")).select(*row(kind, F.col("first") + F.col("p"), text))
    m = c.select("cem_id", "page", "first", F.inline("maps"))
    entries = m.select("cem_id", "page", "first", "ord", F.posexplode("entries").alias("p", "x"))
    return union_all([
        listed("requests", "requests", F.concat_ws("|", "x.prId", "x.mid", "x.ln", "x.plot")),
        listed("memorials", "memorials", F.concat_ws("|", *[F.get("x", F.lit(i)) for i in (0, 1, 2, 3, 4, 5, 8, 9)])),
        listed("roster", "roster", F.concat_ws("|", "x")),
        entries.select(*row("entries", F.col("first") + F.col("p"), F.concat_ws("|", "ord", F.get("x", F.lit(0)), F.get("x", F.lit(1))))),
        m.filter("section IS NOT NULL").select(*row("map", F.col("ord"), F.col("section"))),
        c.filter("name IS NOT NULL").select(*row("cemetery", F.lit(0), F.concat_ws("|", "name", "contact", "generated", F.col("radiusMiles").cast("int")))),
        c.select("cem_id", "page", F.explode("manifest").alias("what", "m")).select(*row("manifest", F.col("m.n"), F.concat_ws("|", "what", "m.pages")))])


_at = lambda by="cem_id": f"row_number() OVER (PARTITION BY {by} ORDER BY ord) - 1"
_paged = f"cast(floor(pos / {_PAGE}) as int) AS page, pos"
view("o_sent", f"""
  SELECT 'requests' AS kind, cem_id, {_at()} AS pos, concat_ws('|', prid, mid, ln, plot) AS row FROM fx_request
  UNION ALL SELECT 'memorials', cem_id, {_at()}, concat_ws('|', mid, name, maiden, "by", dy, plot, flags, fam) FROM fx_memorial
  UNION ALL SELECT 'roster', cem_id, {_at()}, concat_ws('|', key, name, sex, bd, dd, burial, section, sub, block, lot, grave, status, flags, note, former) FROM fx_register
  UNION ALL SELECT 'entries', m.cem_id, {_at("map_id")}, concat_ws('|', map_ord, block, lot) FROM fx_plat_entry e JOIN fx_plat_map m USING (map_id)""")
oracle("publish_bundle", f"""
  SELECT kind, cem_id, {_paged}, row FROM o_sent
  UNION ALL SELECT 'map', cem_id, 0, map_ord, section FROM fx_plat_map
  UNION ALL SELECT 'cemetery', cem_id, 0, 0, concat_ws('|', name, contact, '2024-05-01', 60) FROM fx_cemetery_page
  UNION ALL SELECT 'manifest', cem_id, 0, sum(n), concat_ws('|', kind, sum(ceil(n / {_PAGE}))::bigint) FROM (
    SELECT kind, cem_id, case when kind = 'entries' then row[1] end AS part, count(*) AS n FROM o_sent GROUP BY ALL) GROUP BY kind, cem_id""")


@query("read_bundle")
def _(t):
    """What was published, read back: every row of every table, and what the manifest misses."""
    b = feeds.read_bundle(t.spark, _published(t), one_per_line=True)
    num = lambda c: F.round(F.col(c).cast("double"), 6)
    row = lambda name, ord_, text, x, y: b[name].select(F.lit(name).alias("kind"), F.col("cem_id").cast("int").alias("cem_id"), F.lit(ord_) if isinstance(ord_, int) else F.col(ord_).cast("bigint").alias("ord"),
                                                        F.concat_ws("|", *text).alias("row"), num(x).alias("x"), num(y).alias("y"))
    shape = [
        row("cemetery", 0, ["name", "county", "contact", "as_of", "register_as_of", "interments", F.concat_ws(",", "sg_blocks"), F.round(F.col("declination") * 100).cast("int"), F.round(F.col("miles") * 100).cast("int")], "lat", "lng"),
        row("section", 0, ["section", "radius"], "lat", "lng"),
        row("plat_map", "map_ord", ["map_id", "file", "section", "sub", "style", "quality", *[F.round(F.col(k) * 100).cast("int") for k in "abcdfg"]], "loo_median", "a"),
        row("plat_entry", "ord", ["map_id", "block", "lot"], "x", "y"),
        row("ground_vertex", "v", ["poly"], "lat", "lng"), row("drive_vertex", "v", ["poly"], "lat", "lng"), row("gate", "gate", [F.lit("")], "lat", "lng"),
        row("request", "ord", ["prid", "mid", "fn", "ln", "name", "by", "dy", "plot", "created", "claimed", "problem"], "lat", "lng"),
        row("memorial", "ord", ["mid", "name", "maiden", "by", "dy", "plot", "flags", "fam"], "lat", "lng"),
        row("register", "ord", [*feeds.REGISTER_POS], "key", "key")]
    gaps = pb.bundle_gaps(b).select(F.lit("gap").alias("kind"), F.col("cem_id").cast("int").alias("cem_id"), F.col("n").alias("ord"), F.col("kind").alias("row"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return union_all([*[d.withColumnRenamed(d.columns[2], "ord") for d in shape], gaps])


_xy = "round(lat, 6) AS x, round(lng, 6) AS y"
oracle("read_bundle", f"""
  SELECT 'cemetery' AS kind, cem_id, 0::bigint AS ord, concat_ws('|', name, county, contact, case when as_of = '' then '2024-05-01' else as_of end, register_as_of, interments, case when cem_id % 5 = 2 then 'A,C' else '' end,
         round(declination * 100)::int, round(miles * 100)::int) AS row, {_xy} FROM fx_cemetery_page
  UNION ALL SELECT 'section', cem_id, 0, concat_ws('|', section, radius), {_xy} FROM fx_section_given
  UNION ALL SELECT 'plat_map', cem_id, map_ord, concat_ws('|', cem_id || '-' || map_ord, file, section, sub, style, quality, {", ".join(f"round({k} * 100)::int" for k in "abcdfg")}), round(loo_median, 6), round(a, 6) FROM fx_plat_map
  UNION ALL SELECT 'plat_entry', m.cem_id, {_at("map_id")}, concat_ws('|', m.cem_id || '-' || map_ord, block, lot), round(e.x, 6), round(e.y, 6) FROM fx_plat_entry e JOIN fx_plat_map m USING (map_id)
  UNION ALL SELECT 'ground_vertex', cem_id, v, poly::varchar, {_xy} FROM fx_ground_vertex
  UNION ALL SELECT 'drive_vertex', cem_id, v, poly::varchar, {_xy} FROM fx_drive_vertex
  UNION ALL SELECT 'gate', cem_id, gate, '', {_xy} FROM fx_gate
  UNION ALL SELECT 'request', cem_id, {_at()}, concat_ws('|', prid, mid, fn, ln, name, "by", dy, plot, created, claimed, problem), {_xy} FROM fx_request
  UNION ALL SELECT 'memorial', cem_id, {_at()}, concat_ws('|', mid, name, maiden, "by", dy, plot, flags, fam), {_xy} FROM fx_memorial
  UNION ALL SELECT 'register', cem_id, {_at()}, concat_ws('|', key, name, sex, bd, dd, burial, section, sub, block, lot, grave, status, flags, note, former), key, key FROM fx_register""")


@query("dataset_totals")
def _(t):
    return pb.dataset_totals(t.cemetery, t.request, t.memorial)


view("o_totals", """
  SELECT c.cem_id, 1::bigint AS cemeteries, coalesce(q.n, 0) AS requests, coalesce(m.n, 0) AS memorials, coalesce(m.g, 0) AS gps_anchors FROM fx_cemetery c
  LEFT JOIN (SELECT cem_id, count(*) AS n FROM fx_request GROUP BY 1) q USING (cem_id) LEFT JOIN (SELECT cem_id, count(*) AS n, count(lat) AS g FROM fx_memorial GROUP BY 1) m USING (cem_id)""")
oracle("dataset_totals", """
  SELECT * FROM o_totals UNION ALL SELECT 0, sum(cemeteries)::bigint, sum(requests)::bigint, sum(memorials)::bigint, sum(gps_anchors)::bigint FROM o_totals""")

# ---- maintenance -------------------------------------------------------------------------
view("fx_mem_base", "SELECT * FROM fx_memorial WHERE ord % 5 <> 0")
view("fx_mem_update", "SELECT u.cem_id, u.ord + 1000000000 AS ord, u.mid, u.name || ' II' AS name, u.maiden, u.by, u.dy, u.plot, u.lat, u.lng, u.flags, u.fam FROM fx_memorial u WHERE ord % 5 < 2")


@query("overlay_memorials")
def _(t):
    return mt.overlay_memorials(t.mem_base, t.mem_update).select("cem_id", "mid", "ord", "name", "plot")


oracle("overlay_memorials", """
  SELECT coalesce(u.cem_id, b.cem_id) AS cem_id, coalesce(u.mid, b.mid) AS mid, coalesce(b.ord, u.ord) AS ord, coalesce(u.name, b.name) AS name, coalesce(u.plot, b.plot) AS plot
  FROM fx_mem_base b FULL OUTER JOIN fx_mem_update u ON u.mid = b.mid AND u.cem_id = b.cem_id""")


@query("snapshot_replace")
def _(t):
    present = t.cemetery.filter("cem_id % 3 = 0").select("cem_id")
    new = t.request.filter("cem_id % 6 = 0 AND ord % 2 = 0")
    req = mt.snapshot_replace(t.request, new, present, empty_counts=True).select("cem_id", F.lit("request").alias("kind"), "ord")
    reg = mt.snapshot_replace(t.register, t.register.filter("cem_id % 6 = 0 AND ord % 4 = 1"), present, empty_counts=False).select("cem_id", F.lit("register").alias("kind"), "ord")
    return req.unionByName(reg)


oracle("snapshot_replace", """
  SELECT cem_id, 'request' AS kind, ord FROM fx_request WHERE cem_id % 3 <> 0 OR (cem_id % 6 = 0 AND ord % 2 = 0)
  UNION ALL SELECT cem_id, 'register', ord FROM fx_register WHERE cem_id % 6 <> 0 OR ord % 4 = 1""")


@query("merge_registry")
def _(t):
    listed = t.listing.groupBy("cem_id").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    return mt.merge_registry(listed.filter("cem_id % 3 <> 1"), listed.filter("cem_id % 3 <> 2"), PINNED, t.request.select("cem_id")).select("cem_id", "name", "origin")


oracle("merge_registry", """
  SELECT cem_id, arg_min(name, ord) AS name, case when cem_id % 3 <> 2 then 'fresh' else 'kept' end AS origin FROM fx_listing
  WHERE cem_id % 3 <> 2 OR cem_id IN (7, 8, 4321) OR cem_id IN (SELECT cem_id FROM fx_request) GROUP BY cem_id""")


@query("shrink_guard")
def _(t):
    per = t.memorial.groupBy("cem_id")
    new = per.agg(F.count_if((F.col("cem_id") % 3 != 0) | (F.col("ord") % 10 < 3)).alias("n"), F.count_if(F.expr("ord % 2 = 0")).alias("reported_total"))
    return mt.shrink_guard(new, per.agg(F.count("*").alias("n")))


oracle("shrink_guard", """
  SELECT cem_id, n, n_prev, reported_total, NOT (greatest(reported_total, n_prev) * 0.5 > 100 AND n < greatest(reported_total, n_prev) * 0.5) AS accepted FROM (
    SELECT cem_id, count_if(cem_id % 3 <> 0 or ord % 10 < 3) AS n, count(*) AS n_prev, count_if(ord % 2 = 0) AS reported_total FROM fx_memorial GROUP BY cem_id)""")

view("fx_stage_state", """
  SELECT k AS cem_id, 'memorials' AS stage, 1700000000 - (k * 7919) % 1000000 AS ts FROM fx_base WHERE k % 3 <> 0 UNION ALL SELECT k, 'registers', 1700000000 - (k * 104729) % 9000000 FROM fx_base WHERE k % 2 = 0""")
view("fx_registry", "SELECT k AS cem_id FROM fx_base")


@query("stale_partitions")
def _(t):
    return mt.stale_partitions(t.registry, t.stage_state, {"memorials": 7 * 86400, "registers": 60 * 86400}, 1700000000)


oracle("stale_partitions", """
  SELECT r.cem_id, c.stage, ts is null or 1700000000 - ts > cadence AS due, case when ts is null then 'missing' when 1700000000 - ts > cadence then 'stale' end AS reason
  FROM fx_registry r CROSS JOIN (VALUES ('memorials', 604800), ('registers', 5184000)) c(stage, cadence) LEFT JOIN fx_stage_state s ON s.cem_id = r.cem_id AND s.stage = c.stage""")

view("fx_cached_key", "SELECT cem_id AS register, q + 1 AS key, q % 6 = 2 or q > 550 AS miss FROM fx_base WHERE q % 5 <> 3")


@query("missing_keys")
def _(t):
    return mt.missing_keys(t.cached_key, t.cached_key.groupBy("register").agg((F.max("key") + 20).alias("max_key")))


oracle("missing_keys", """
  SELECT r.register, k.key FROM (SELECT register, max(case when not miss then key end) AS last FROM fx_cached_key GROUP BY 1) r JOIN (SELECT register, unnest(generate_series(1, max(key) + 20)) AS key FROM fx_cached_key GROUP BY register) k ON k.register = r.register
  WHERE NOT EXISTS (SELECT 1 FROM fx_cached_key c WHERE c.register = r.register AND c.key = k.key AND (NOT c.miss OR c.key <= r.last))""")


@query("normalize_register")
def _(t):
    r = t.register.withColumn("lot", F.when(F.col("ord") % 3 == 1, "1").otherwise(F.col("lot"))) \
        .withColumn("section", F.when(F.col("ord") % 7 == 1, "Single Grave").when(F.col("ord") % 7 == 3, F.concat(F.lit("0"), "grave")).otherwise(F.col("section"))) \
        .withColumn("lot", F.when(F.col("ord") % 14 == 1, "").otherwise(F.col("lot")))
    return mt.normalize_register(r, ("B", "E")).select("cem_id", "key", "section", "sub", "block", "lot", "grave")


oracle("normalize_register", """
  SELECT cem_id, key, case when regexp_matches(s, '^[0-9]+$') then 'Section ' || ltrim(s, '0') when s = '' then '*' else s end AS section, sub, block, case when shift then grave else l end AS lot, case when shift then '' else grave end AS grave
  FROM (SELECT *, (s = 'Single Grave' and l = '') or (block in ('B', 'E') and l in ('', '1')) AS shift FROM (
    SELECT *, case when ord % 7 = 1 then 'Single Grave' when ord % 7 = 3 then '0' || grave else section end AS s, case when ord % 14 = 1 then '' when ord % 3 = 1 then '1' else lot end AS l FROM fx_register))""")

view("fx_photo_stored", "SELECT cast(user_id as string) AS pk, cast(event_id % 3 as int) AS slot, min('h' || cast(event_id % 5 as string)) AS sha FROM events WHERE event_id % 4 = 0 GROUP BY user_id, event_id % 3")
view("fx_photo_incoming", """
  SELECT event_id AS arrival, cast(user_id as string) AS pk, cast(event_id % 3 as int) AS slot, 'h' || cast(event_id % 5 as string) AS sha,
         cast(case when event_id % 31 = 0 then 0 when event_id % 37 = 0 then 30000000 else 5000 end as bigint) AS size, case when event_id % 41 = 0 then '8950' else 'FFD8' end AS magic FROM events WHERE event_id % 4 <> 0""")


@query("assign_photo_slots")
def _(t):
    return mt.assign_photo_slots(t.photo_stored, t.photo_incoming)


oracle("assign_photo_slots", """
  WITH good AS (SELECT * FROM fx_photo_incoming WHERE size BETWEEN 1 AND 26214400 AND magic = 'FFD8'),
       att AS (SELECT g.*, s.sha AS have, first_value(g.sha) OVER w AS won, first_value(g.arrival) OVER w AS won_at FROM good g LEFT JOIN fx_photo_stored s USING (pk, slot) WINDOW w AS (PARTITION BY g.pk, g.slot ORDER BY g.arrival)),
       st AS (SELECT *, case when have = sha then 'retry' when have is null and won_at = arrival then 'as asked' when have is null and won = sha then 'retry' else 'move' end AS state FROM att),
       used AS (SELECT pk, slot FROM fx_photo_stored UNION SELECT pk, slot FROM att WHERE have is null),
       free AS (SELECT pk, n AS slot, row_number() OVER (PARTITION BY pk ORDER BY n) AS i FROM (SELECT DISTINCT pk FROM st) p CROSS JOIN (SELECT unnest(generate_series(1, 99)) AS n) k
                WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.pk = p.pk AND u.slot = k.n)),
       mv AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY arrival) AS i FROM st WHERE state = 'move')
  SELECT arrival, pk, cast(slot as int) AS slot, state AS result FROM st WHERE state <> 'move'
  UNION ALL SELECT m.arrival, m.pk, cast(f.slot as int), case when f.slot is null then 'no slot' else 'moved' end FROM mv m LEFT JOIN free f ON f.pk = m.pk AND f.i = m.i
  UNION ALL SELECT arrival, pk, null, case when size = 0 then 'empty' when size > 26214400 then 'too large' else 'not a jpeg' end FROM fx_photo_incoming WHERE NOT (size BETWEEN 1 AND 26214400 AND magic = 'FFD8')""")
