"""Burial tables derived from the given parquet tables (one text for both engines)."""

import re

from pyspark.sql import DataFrame, SparkSession

from plotlink.catalog.views import BASE_TABLES, with_views

SUR = ("smith,smyth,miller,millar,johnson,johnston,brown,browne,clark,clarke,oster,hofstetter,"
       "hoffstetter,whitcomb,nelson,nielsen,gray,grey,moore,moor,baker,backer,allen,allan,newcomb,"
       "newcombe,fisk,fiske,wood,woods,ellis,ellison,stone,stowe,hollow,holloway,birch,burch,ash,ashe")
FST = ("robert,margaret,william,elizabeth,john,mary,charles,sarah,henry,martha,james,catherine,thomas,"
       "dorothy,edward,frances,george,harriet,joseph,eleanor,albert,caroline,samuel,henrietta")
NCK = ("bob,peggy,bill,betty,jack,polly,chas,sally,hank,mattie,jim,kate,tom,dot,ed,fannie,geo,hattie,"
       "joe,nellie,bert,carrie,sam,nettie")


def _word(words: str, index: str) -> str:
    return f"split_part('{words}', ',', cast({index} as int))"


def _letter(letters: str, index: str) -> str:
    return f"split_part('{','.join(letters)}', ',', cast({index} as int))"


# where a burial row's stone stands, in degrees, from its plot numbers
_LAT = "(c.lat + (20 + 60 * b.si + 3 * b.lot + b.k % 5 - 2) / 111195e0)"
_LNG = "(c.lng + (12 * b.bi + b.k % 7 - 3) / 81000e0)"

VIEWS = {
    "fx_cemetery": """
        SELECT cast(n.n_nationkey + 1 as int) AS cem_id, n.n_name AS name, r.r_name AS county,
               43e0 + 0.02e0 * n.n_nationkey AS lat, -84e0 - 0.015e0 * n.n_nationkey AS lng,
               cast(case when n.n_nationkey % 4 = 0 then 1960 + n.n_nationkey end as int) AS register_as_of,
               cast(200 + 300 * (n.n_nationkey % 5) as int) AS interments
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "fx_base": f"""
        SELECT k, cem_id, q,
               {_word(SUR, '(7 * q) % 40 + 1')} AS sur, {_word(SUR, '(7 * q + 3) % 40 + 1')} AS sur2,
               {_word(FST, '(13 * q + cem_id) % 24 + 1')} AS fst, {_word(NCK, '(13 * q + cem_id) % 24 + 1')} AS nck,
               {_word(SUR, '(7 * (q + 1)) % 40 + 1')} AS kin_sur,
               {_word(FST, '(13 * (q + 1) + cem_id) % 24 + 1')} AS kin_fst,
               cast(case when k % 11 = 0 then 0 else 1820 + (17 * q) % 110 end as int) AS by_,
               cast(case when k % 13 = 0 then 0 else 1835 + (17 * q) % 110 + (29 * q) % 75 end as int) AS dy_,
               cast(q % 4 as int) AS si, cast(q % 6 as int) AS bi,
               {_letter('ABCD', 'q % 4 + 1')} AS sec, {_letter('ABCDEF', 'q % 6 + 1')} AS blk,
               {_word('North,South,East,West', 'q % 4 + 1')} AS sec_name,
               cast((5 * q) % 23 + 1 as int) AS lot, cast(q % 4 + 1 as int) AS grave
        FROM (SELECT o_orderkey AS k, cast(o_orderkey % 25 + 1 as int) AS cem_id,
                     cast(floor(o_orderkey / 25) as bigint) AS q FROM orders) src""",
    "fx_memorial": f"""
        SELECT b.cem_id, b.k AS ord, b.k + 1 AS mid, b.fst || ' ' || b.sur AS name,
               case when b.k % 9 = 0 then b.sur2 else '' end AS maiden, b.by_ AS by, b.dy_ AS dy,
               case b.k % 8
                 when 3 then ''
                 when 4 then 'No Location Given (old book)'
                 when 2 then 'Row ' || b.blk || ' Lot ' || cast(b.lot as string) || ' Space ' || cast(b.grave as string)
                 when 6 then cast(b.lot as string) || 'B'
                 when 5 then 'Maple-' || b.sec_name || '-' || b.blk || '-0' || cast(b.lot as string) || '-' || cast(b.grave as string)
                 else 'Section ' || b.sec || ', Blk ' || b.blk || ', Lot ' || cast(b.lot as string) || ', Grave ' || cast(b.grave as string)
               end AS plot,
               case when b.k % 3 <> 0 then null when b.k % 31 = 0 then c.lat when b.k % 37 = 0 then c.lat + 0.02e0
                    else round({_LAT}, 6) end AS lat,
               case when b.k % 3 <> 0 then null when b.k % 31 = 0 or b.k % 37 = 0 then c.lng
                    else round({_LNG}, 6) end AS lng,
               cast(b.k % 2 + case when b.k % 41 = 5 then 2 else 0 end + case when b.k % 17 = 0 then 4 else 0 end as int) AS flags,
               case when b.k % 5 = 0 then b.kin_fst || ' ' || b.kin_sur else '' end AS fam
        FROM fx_base b JOIN fx_cemetery c ON b.cem_id = c.cem_id""",
    "fx_register": """
        SELECT cem_id, k AS ord, k AS key,
               upper(sur || case when k % 10 = 1 then 'e' else '' end || ', ' || case when k % 4 = 1 then nck else fst end) AS name,
               case when k % 3 = 1 then 'M' else 'F' end AS sex,
               case when by_ = 0 or k % 35 = 7 then '' else 'abt ' || cast(by_ + case when k % 5 = 2 then 1 else 0 end as string) end AS bd,
               case when k % 19 = 0 or dy_ = 0 or k % 35 = 7 then '' else '03/20/' || cast(dy_ as string) end AS dd,
               case when dy_ = 0 or k % 35 = 7 then '' else cast(dy_ as string) end AS burial,
               case when k % 23 = 0 then '' else 'Section ' || sec end AS section, '' AS sub, blk AS block,
               lpad(cast(lot as string), 2, '0') AS lot, cast(grave as string) AS grave, '' AS status,
               cast(case when k % 17 = 0 then 4 else 0 end as int) AS flags, '' AS note,
               case when k % 15 = 0 then upper(sur2 || ', ' || fst) else '' end AS former
        FROM fx_base WHERE k % 2 = 1""",
    "fx_request": """
        SELECT m.cem_id, m.ord, m.ord AS prid, m.mid, split_part(m.name, ' ', 1) AS fn, split_part(m.name, ' ', 2) AS ln,
               m.name, nullif(m.by, 0) AS by, nullif(m.dy, 0) AS dy,
               case when m.ord % 2 = 0 then '' else m.plot end AS plot,
               case when m.ord % 11 = 0 then round(c.lat + 0.001e0, 6) when m.ord % 13 = 0 then c.lat end AS lat,
               case when m.ord % 11 = 0 or m.ord % 13 = 0 then c.lng end AS lng,
               case when m.ord % 6 = 0 then '2024-02-01' else '' end AS claimed,
               case when m.ord % 8 = 3 then 'no  stone found' else '' end AS problem,
               '20' || cast(20 + m.ord % 5 as string) || '-0' || cast(m.ord % 9 + 1 as string) || '-15' AS created
        FROM fx_memorial m JOIN fx_cemetery c ON m.cem_id = c.cem_id WHERE m.ord % 41 = 5""",
    "fx_progress": """
        SELECT event_id AS arrival, cast(41 * user_id + 6 as string) AS pk,
               cast(floor(@EPOCH_US(ts)@ / 3600000000e0) as bigint) AS ts,
               case event_type when 'purchase' then 'done' when 'error' then 'notfound' when 'click' then 'nostone'
                               when 'signup' then null else '' end AS st,
               case when event_type = 'signup' then null else 'v' || cast(event_id % 7 as string) end AS note,
               event_type = 'signup' AS tombstone,
               case when event_type = 'signup' then null else event_id % 5 = 0 end AS photo,
               case when event_type = 'signup' then null else event_id % 10 = 0 end AS up
        FROM events""",
    "fx_pin": f"""
        SELECT p.arrival, p.ts, b.cem_id,
               case when b.k % 2 = 1 and p.arrival % 3 = 0 then 'ros:' || cast(b.k as string) else p.pk end AS pk,
               case when p.arrival % 29 = 0 then c.lat + 0.027e0 else round({_LAT}, 6) end AS lat,
               case when p.arrival % 29 = 0 then c.lng else round({_LNG}, 6) end AS lng
        FROM fx_progress p JOIN events e ON p.arrival = e.event_id
        JOIN fx_base b ON cast(b.k + 1 as string) = p.pk
        JOIN fx_cemetery c ON b.cem_id = c.cem_id WHERE e.event_type = 'view'""",
    "fx_part": f"""
        SELECT k, cem_id, q, cast(q % 4 as int) AS si, cast(q % 6 as int) AS bi,
               {_letter('ABCD', 'q % 4 + 1')} AS sec, {_letter('ABCDEF', 'q % 6 + 1')} AS blk,
               cast((5 * q) % 23 + 1 as int) AS lot
        FROM (SELECT p_partkey AS k, cast(p_partkey % 25 + 1 as int) AS cem_id,
                     cast(floor(p_partkey / 25) as bigint) AS q FROM part) src""",
    "fx_plat_map": """
        SELECT cast(cem_id * 4 + si as int) AS map_id, cem_id, 'plat-' || cast(si as string) AS file, si AS map_ord,
               'Section ' || substr('ABCD', si + 1, 1) AS section, '' AS sub, case when si = 3 then 'lots' else 'blocks' end AS style,
               0.7e0 AS a, 0e0 AS b, -5e0 AS c, 0e0 AS d, 0.7e0 AS f, 8e0 AS g,
               case si when 0 then 'good' when 1 then 'fair' when 2 then 'approx' else 'poor' end AS quality,
               4.2e0 + 2 * si AS loo_median
        FROM (SELECT cem_id, cast(si0 as int) AS si FROM (SELECT cem_id, @SEQ(0, 3)@ AS si0 FROM fx_cemetery) s0) src""",
    "fx_plat_entry": """
        SELECT cast(cem_id * 4 + si as int) AS map_id, cem_id, k AS ord, blk AS block, cast(lot as string) AS lot,
               (12 * bi + 5) / 0.7e0 AS x, (20 + 60 * si + 3 * lot - 8) / 0.7e0 AS y
        FROM fx_part""",
    "fx_section_given": """
        SELECT cem_id, 'Section D' AS section, round(lat + 0.002e0, 6) AS lat, round(lng + 0.0004e0, 6) AS lng,
               cast(null as int) AS radius
        FROM fx_cemetery WHERE cem_id % 5 = 0""",
    # two outlines per cemetery: a rectangle and a concave pentagon, vertices in order
    "fx_ground_vertex": """
        SELECT cem_id, cast(poly as int) AS poly, cast(v as int) AS v, cast(poly_n as int) AS n_v,
               lat + cast(split_part(case poly when 0 then '15,15,140,140' else '150,150,300,205,300' end, ',', cast(v + 1 as int)) as double) / 111195e0 AS lat,
               lng + cast(split_part(case poly when 0 then '-30,40,40,-30' else '-30,45,45,5,-30' end, ',', cast(v + 1 as int)) as double) / 81000e0 AS lng
        FROM (SELECT cem_id, lat, lng, poly, poly_n, @SEQ(0, poly_n - 1)@ AS v
              FROM (SELECT cem_id, lat, lng, poly, 4 + poly AS poly_n
                    FROM (SELECT cem_id, lat, lng, @SEQ(0, 1)@ AS poly FROM fx_cemetery) p0) p1) p2
        WHERE cem_id % 6 <> 0""",
    "fx_line": f"""
        SELECT cem_id AS file, q AS line,
               case when q % 60 = 0 then 'SECTION ' || {_word('one,two,three', 'floor(q / 60) % 3 + 1')}
                    when q % 12 = 0 then 'Row ' || {_word('one,two,three,four,five', 'floor(q / 12) % 5 + 1')}
                    when q % 60 = 59 then 'transcribed by hand'
                    else upper(substr(sur, 1, 1)) || substr(sur, 2) || ', ' || fst || '  '
                         || cast(1835 + (17 * q) % 110 as string)
                         || case when q % 7 = 3 then '' else ' - ' || cast(1850 + (17 * q) % 110 + (29 * q) % 75 as string) end
                         || case when q % 5 = 2 then ' (burial Apr. 25)' else '' end end AS text
        FROM fx_base""",
    "fx_observer": """
        SELECT e.event_id AS observer_id, b.cem_id, b.k + 1 AS mid,
               c.lat + (e.event_id % 400) / 111195e0 AS lat, c.lng + (e.event_id % 90 - 45) / 81000e0 AS lng
        FROM events e JOIN fx_base b ON b.k = 41 * e.user_id + 5 JOIN fx_cemetery c ON b.cem_id = c.cem_id""",
}


_SPREAD = {"orders": "o_orderkey", "events": "event_id", "part": "p_partkey"}
#: Rows of a base table that one task takes through the text work.
TASK_ROWS = 100_000
_PARTS = {}


def _base(spark: SparkSession, sf_dir: str, table: str) -> str:
    """A base table; one that arrives in fewer splits than there are cores, or with more rows in a split than a task
    should take, is spread, because the text work downstream is what takes the time and splits follow bytes, not rows."""
    path = f"{sf_dir}/{table}.parquet"
    if table not in _SPREAD:
        return f"SELECT * FROM parquet.`{path}`"
    if path not in _PARTS:
        df = spark.read.parquet(path)
        _PARTS[path] = (df.rdd.getNumPartitions(), -(-df.count() // TASK_ROWS))
    splits, needed = _PARTS[path]
    parts = max(needed, spark.sparkContext.defaultParallelism)
    hint = f"/*+ REPARTITION({parts}, {_SPREAD[table]}) */ " if splits < parts else ""
    return f"SELECT {hint}* FROM parquet.`{path}`"


def fixture(spark: SparkSession, sf_dir: str, name: str, views=None) -> DataFrame:
    final, views = f"SELECT * FROM {name}", views or VIEWS
    # tables the view does not read are not counted either
    words = set(re.findall(r"\w+", with_views(final, views, "spark")))
    return spark.sql(with_views(final, views, "spark", {t: _base(spark, sf_dir, t) for t in BASE_TABLES if t in words}))
