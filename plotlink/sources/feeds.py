"""Bundles, JSON feeds and sheets read into the burial tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotlink import config as C
from plotlink.functions import dates, geo, plots
from plotlink.functions.frames import once
from plotlink.functions.lineage import written

MEMORIAL_POS = ["mid", "name", "maiden", "by", "dy", "plot", "lat", "lng", "flags", "fam"]
REGISTER_POS = ["key", "name", "sex", "bd", "dd", "burial", "section", "sub", "block", "lot", "grave", "status", "flags", "note", "former"]


#: Ordinals leave room for 2^32 rows on a page, more than one document can hold.
PAGE_BITS = 32


def _ord(df: DataFrame, pos: str) -> Column:
    """Row order across the pages of a feed (one document per page, or a single one). A page that says where its
    first row stands counts on from there."""
    page = F.col("page") if "page" in df.columns else F.lit(0)
    base = F.shiftleft(page.cast("bigint"), PAGE_BITS)
    return ((F.coalesce("first", base) if "first" in df.columns else base) + F.col(pos)).alias("ord")


def _positional(df: DataFrame, json_col: str, names_: list[str]) -> DataFrame:
    rows = F.from_json(F.col(json_col), "array<array<string>>")
    df = df.select(*[c for c in df.columns if c != json_col], F.posexplode_outer(rows).alias("_p", "_r"))
    return _cells(df, "_p", "_r", names_)


def _cells(df: DataFrame, pos: str, row: str, names_: list[str]) -> DataFrame:
    return df.filter(F.col(row).isNotNull()).select("cem_id", _ord(df, pos), *[F.get(row, F.lit(i)).alias(n) for i, n in enumerate(names_)])


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).alias(c)


def read_memorial_rows(df: DataFrame, json_col: str = "rows") -> DataFrame:
    """Positional memorial arrays to typed rows. A repeated memorial keeps its first place
    and its last values; rows without a number are dropped."""
    return _memorials(_positional(df, json_col, MEMORIAL_POS))


def _memorials(df: DataFrame) -> DataFrame:
    df = df.withColumn("mid", F.col("mid").try_cast("double").cast("bigint")).filter("mid <> 0")
    rest = [c for c in MEMORIAL_POS if c != "mid"]
    df = df.groupBy("cem_id", "mid").agg(F.max_by(F.struct(*rest), "ord").alias("v"), F.min("ord").alias("ord")).select("cem_id", "ord", "mid", "v.*")
    num = lambda c, t: F.coalesce(F.col(c).try_cast(t), F.lit(0)).alias(c)
    return df.select("cem_id", "ord", "mid", _text("name"), _text("maiden"), num("by", "int"), num("dy", "int"), _text("plot"),
                     F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"), num("flags", "int"), _text("fam"))


def read_register_rows(df: DataFrame, json_col: str = "rows") -> DataFrame:
    return _registers(_positional(df, json_col, REGISTER_POS))


def _registers(df: DataFrame) -> DataFrame:
    return df.select("cem_id", "ord", F.col("key").try_cast("bigint").alias("key"),
                     *[F.coalesce(F.col("flags").try_cast("int"), F.lit(0)).alias(c) if c == "flags" else _text(c) for c in REGISTER_POS[1:]])


_ROWS = "array<array<string>>"
_BUNDLE = (
    "v int, page int, generated string, home struct<lat:double,lng:double>, radiusMiles double, cemeteries array<struct<"
    "id:bigint,first:bigint,manifest:map<string,struct<n:bigint,pages:bigint>>,name:string,county:string,lat:double,lng:double,miles:double,declination:double,contact:string,"
    "meta:struct<asOf:string,memorialsAsOf:string,interments:bigint>,rosterAsOf:int,sgBlocks:array<string>,"
    "sections:map<string,struct<lat:double,lng:double,radius:double>>,"
    "maps:array<struct<ord:int,file:string,section:string,sub:string,style:string,quality:string,looMedian:double,"
    "transform:struct<a:double,b:double,c:double,d:double,f:double,g:double>,entries:" + _ROWS + ">>,"
    "grounds:struct<bounds:array<array<array<double>>>,drives:array<array<array<double>>>,gates:array<array<double>>>,"
    "requests:array<struct<prId:bigint,mid:bigint,fn:string,ln:string,name:string,by:int,dy:int,bd:string,dd:string,plot:string,"
    "notes:string,req:string,created:string,lat:double,lng:double,claimed:string,problem:string>>,"
    "memorials:" + _ROWS + ",roster:" + _ROWS + ">>"
)


def _listed_rows(c: DataFrame) -> DataFrame:
    """cem_id, page, first, kind, map_ord, _p, cells, r: the rows of all lists of the documents, written, so that texts are
    parsed for them once and not for every table."""
    request = F.col("c.requests")
    kinds = c.schema["c"].dataType
    cells, asked = kinds["memorials"].dataType.elementType, kinds["requests"].dataType.elementType
    item = lambda kind, at, pos, row, r: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("map_ord"), pos.alias("_p"), row.cast(cells).alias("cells"), r.cast(asked).alias("r"))
    none = F.lit(None)
    kept = f"array<struct<kind:string,map_ord:int,_p:int,cells:{cells.simpleString()},r:{asked.simpleString()}>>"
    some = lambda rows: F.coalesce(rows, F.array().cast(kept))
    of_map = F.transform("c.maps", lambda m, k: some(F.transform(m["entries"], lambda e, i: item("entry", F.coalesce(m["ord"], k), i, e, none))))
    lists = [F.transform(request, lambda x, i: item("request", none, i, none, x)), F.flatten(of_map),
             F.transform("c.memorials", lambda x, i: item("memorial", none, i, x, none)), F.transform("c.roster", lambda x, i: item("register", none, i, x, none))]
    return written(c.select("cem_id", "page", "first", F.inline(F.concat(*[some(x) for x in lists]))), "bundle-rows")


def _facts(c: DataFrame) -> DataFrame:
    """The documents without their lists, written."""
    maps = F.transform("c.maps", lambda m: m.dropFields("entries"))
    return written(c.withColumn("c", F.col("c").dropFields("requests", "memorials", "roster").withField("maps", maps)), "bundle-facts")


def read_bundle(spark: SparkSession, path: str, one_per_line: bool = False) -> dict[str, DataFrame]:
    """A published bundle (one JSON document per file, or one per line) to
    tables: cemetery, section, plat_map, plat_entry, ground_vertex, drive_vertex, gate, request, memorial,
    register, manifest. Also reads the older single-cemetery document, whose facts sit under ``meta``.
    A large cemetery may be spread over documents with a ``page`` number each; one of them holds its facts."""
    schema = T.StructType.fromDDL(_BUNDLE)
    one_cem = schema["cemeteries"].dataType.elementType
    facts = T.StructType.fromDDL("cemetery string, fagCemeteryId bigint, cem struct<lat:double,lng:double>, declination double, asOf string")
    lists = ("rosterAsOf", "sgBlocks", "sections", "maps", "grounds", "requests", "memorials", "roster")
    top = T.StructType([*schema.fields, T.StructField("meta", facts), *[T.StructField(n, one_cem[n].dataType) for n in lists]])
    raw = spark.read.schema(top).option("multiLine", not one_per_line).json(path)
    one = F.array(F.struct(
        F.coalesce("meta.fagCemeteryId", F.lit(0)).alias("id"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast(one_cem["manifest"].dataType).alias("manifest"),
        F.coalesce("meta.cemetery", F.lit("Cemetery")).alias("name"), F.lit("").alias("county"),
        F.col("meta.cem.lat").alias("lat"), F.col("meta.cem.lng").alias("lng"), F.lit(0.0).alias("miles"), F.col("meta.declination").alias("declination"),
        F.lit("").alias("contact"), F.struct(F.col("meta.asOf").alias("asOf"), F.lit(None).cast("string").alias("memorialsAsOf"), F.lit(None).cast("bigint").alias("interments")).alias("meta"),
        "rosterAsOf", "sgBlocks", "sections", "maps", "grounds", "requests", "memorials", "roster"))
    c = raw.select("generated", F.coalesce("page", F.lit(0)).alias("page"), F.posexplode(F.when(F.col("v") == 2, F.col("cemeteries")).otherwise(one)).alias("pos", "c")) \
        .withColumns({"cem_id": F.col("c.id"), "first": F.col("c.first")})
    listed, c = _listed_rows(c), _facts(c)
    cemetery = c.select(
        "cem_id", F.coalesce("c.name", F.concat(F.lit("Cemetery "), F.col("cem_id"))).alias("name"), F.coalesce("c.county", F.lit("")).alias("county"),
        F.col("c.lat").alias("lat"), F.col("c.lng").alias("lng"), F.col("c.miles").alias("miles"),
        F.coalesce("c.declination", F.lit(C.DEFAULT_DECLINATION)).alias("declination"), F.coalesce("c.contact", F.lit("")).alias("contact"),
        F.coalesce(F.nullif("c.meta.memorialsAsOf", F.lit("")), F.nullif("c.meta.asOf", F.lit("")), "generated", F.lit("")).alias("as_of"),
        F.col("c.rosterAsOf").alias("register_as_of"), F.coalesce("c.sgBlocks", F.array().cast("array<string>")).alias("sg_blocks"),
        F.coalesce("c.meta.interments", F.lit(0)).alias("interments"), F.struct(F.col("c.lat").isNotNull().alias("has"), (-F.col("page")).alias("page")).alias("_told"))
    names_ = [x for x in cemetery.columns if x not in ("cem_id", "_told")]
    # the first document that says where the cemetery is
    cemetery = cemetery.groupBy("cem_id").agg(F.max_by(F.struct(*names_), "_told").alias("f")).select("cem_id", "f.*")
    m = c.select("cem_id", "first", F.posexplode("c.maps").alias("_at", "m")).withColumn("map_ord", F.coalesce("m.ord", "_at")).withColumn("map_id", F.concat_ws("-", "cem_id", "map_ord"))
    requests = listed.filter("kind = 'request'")
    requests = requests.select("cem_id", _ord(requests, "_p"), "r.*").filter("mid <> 0")
    path_of = lambda field: c.select("cem_id", F.posexplode(field).alias("poly", "p")).select("cem_id", "poly", F.posexplode("p").alias("v", "q")).select(
        "cem_id", "poly", "v", F.get("q", F.lit(0)).alias("lat"), F.get("q", F.lit(1)).alias("lng"))
    rows_of = lambda kind, names_: _cells(listed.filter(F.col("kind") == kind), "_p", "cells", names_)
    entries = listed.filter("kind = 'entry'").withColumn("map_id", F.concat_ws("-", "cem_id", "map_ord"))
    return {
        "cemetery": cemetery,
        "section": c.select("cem_id", F.explode("c.sections").alias("section", "s")).select("cem_id", "section", "s.lat", "s.lng", F.col("s.radius").cast("int").alias("radius")),
        "plat_map": m.filter("m.file IS NOT NULL OR m.section IS NOT NULL OR m.transform IS NOT NULL").select(
            "map_id", "cem_id", "map_ord", "m.file", "m.section", F.coalesce("m.sub", F.lit("")).alias("sub"), "m.style", "m.transform.*", "m.quality", F.col("m.looMedian").alias("loo_median")),
        "plat_entry": entries.select(
            "map_id", "cem_id", (F.coalesce("first", F.lit(0)) + F.col("_p")).cast("bigint").alias("ord"), F.get("cells", F.lit(0)).alias("block"), F.get("cells", F.lit(1)).alias("lot"),
            F.get("cells", F.lit(2)).try_cast("double").alias("x"), F.get("cells", F.lit(3)).try_cast("double").alias("y")),
        "ground_vertex": path_of("c.grounds.bounds"),
        "drive_vertex": path_of("c.grounds.drives"),
        "gate": c.select("cem_id", F.posexplode("c.grounds.gates").alias("gate", "q")).select("cem_id", "gate", F.get("q", F.lit(0)).alias("lat"), F.get("q", F.lit(1)).alias("lng")),
        "request": requests.withColumnsRenamed({"prId": "prid"}),
        "memorial": _memorials(rows_of("memorial", MEMORIAL_POS)),
        "register": _registers(rows_of("register", REGISTER_POS)),
        "manifest": c.select("cem_id", F.explode("c.manifest").alias("kind", "m")).select("cem_id", "kind", "m.n", "m.pages"),
    }


def _first(record: Column, *aliases: str) -> Column:
    """First non-empty of several spellings of a field."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(a)), F.lit("")) for a in aliases])


def _clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _keep_pin(df: DataFrame, cemetery: DataFrame, lo: float, hi: float, planar: bool) -> DataFrame:
    cem = cemetery.select("cem_id", F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    df = df.join(cem, "cem_id", "left")
    if planar:
        d = geo.dist(geo.east(F.col("lng"), F.col("_a"), F.col("_b")), geo.north(F.col("lat"), F.col("_a")), F.lit(0.0), F.lit(0.0))
    else:
        d = geo.haversine(F.col("lat"), F.col("lng"), F.col("_a"), F.col("_b"))
    df = df.withColumn("_ok", F.coalesce(d.between(lo, hi), F.lit(False)))
    return df.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("lat", "lng")}).drop("_a", "_b", "_ok")


def import_requests_json(feed: DataFrame, cemetery: DataFrame) -> DataFrame:
    """A request feed (a bare array or one under photoRequests/requests) to request rows.
    ``feed``: cem_id, json."""
    arr = F.coalesce(*[F.get_json_object("json", p) for p in ("$.photoRequests", "$.requests")], F.col("json"))
    df = feed.select(*[c for c in feed.columns if c != "json"], F.posexplode(F.from_json(arr, "array<map<string,string>>")).alias("_p", "r"))
    r = F.col("r")
    from_memorial = F.try_element_at(r, F.lit("latLonMethod")) == "memorial"
    coord = lambda long, short: F.coalesce(F.when(from_memorial, _first(r, long)), F.try_element_at(r, F.lit(short))).try_cast("double")
    full = F.trim(F.concat_ws(" ", F.coalesce(_first(r, "firstName"), F.lit("")), F.coalesce(_first(r, "lastName"), F.lit(""))))
    txt = lambda *a: F.coalesce(_first(r, *a), F.lit(""))
    df = df.select(
        "cem_id", _ord(df, "_p"), _first(r, "photoRequestId", "prId").try_cast("bigint").alias("prid"),
        _first(r, "memorialId", "mid").try_cast("bigint").alias("mid"), txt("firstName", "fn").alias("fn"), txt("lastName", "ln").alias("ln"),
        F.coalesce(_first(r, "memorialName", "name"), full).alias("name"),
        F.nullif(_first(r, "birthYear", "by").try_cast("int"), F.lit(0)).alias("by"), F.nullif(_first(r, "deathYear", "dy").try_cast("int"), F.lit(0)).alias("dy"),
        txt("longPlot", "plot").alias("plot"), txt("notes").alias("notes"), txt("reqPublicName", "req").alias("req"), txt("dateCreated", "created").alias("created"),
        txt("dateClaimed", "claimed").alias("claimed"), F.substring(_clean_text(_first(r, "problemDetails", "problems", "problem")), 1, 140).alias("problem"),
        coord("latitude", "lat").alias("lat"), coord("longitude", "lng").alias("lng"))
    return _keep_pin(df.filter("mid <> 0"), cemetery, 5, 800, planar=False)


def import_memorials_json(feed: DataFrame, cemetery: DataFrame) -> DataFrame:
    """A memorial feed (records/collection/bare array of objects, or compact rows) to
    memorial rows; flags packed, pins kept from 5 to 500 m (planar) and rounded."""
    arr = F.coalesce(*[F.get_json_object("json", p) for p in ("$.records", "$.collection")], F.col("json"))
    df = feed.select(*[c for c in feed.columns if c != "json"], F.posexplode(F.from_json(arr, "array<string>")).alias("_p", "one"))
    df = df.withColumn("ord", _ord(df, "_p"))
    r = F.from_json("one", "map<string,string>")
    objects = df.filter(F.col("one").startswith("{")).withColumn("r", r)
    r = F.col("r")
    truthy = lambda k: ~F.coalesce(F.try_element_at(r, F.lit(k)), F.lit("")).isin("", "false", "0", "null")
    bit = lambda k, i: F.when(truthy(k), F.lit(1 << i)).otherwise(0)
    num = lambda k: F.coalesce(_first(r, k).try_cast("int"), F.lit(0))
    objects = objects.select(
        "cem_id", "ord", _first(r, "memorialId").try_cast("bigint").alias("mid"), F.coalesce(_first(r, "fullName"), F.lit("")).alias("name"),
        F.coalesce(_first(r, "maidenName"), F.lit("")).alias("maiden"), num("birthYear").alias("by"), num("deathYear").alias("dy"),
        _clean_text(_first(r, "plot")).alias("plot"), F.try_element_at(r, F.lit("latitude")).try_cast("double").alias("lat"),
        F.try_element_at(r, F.lit("longitude")).try_cast("double").alias("lng"),
        (bit("intermentHasPhoto", 0).bitwiseOR(bit("photoRequest", 1)).bitwiseOR(bit("isVeteran", 2)).bitwiseOR(bit("personHasPhoto", 3))).alias("flags")).filter("mid <> 0")
    objects = _keep_pin(objects, cemetery, 5, 500, planar=True).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})
    a = F.from_json("one", "array<string>")
    at = lambda i: F.get("a", F.lit(i))
    compact = df.filter(F.col("one").startswith("[")).withColumn("a", a).select(
        "cem_id", "ord", at(0).try_cast("bigint").alias("mid"), F.coalesce(at(1), F.lit("")).alias("name"), F.coalesce(at(2), F.lit("")).alias("maiden"),
        F.coalesce(at(3).try_cast("int"), F.lit(0)).alias("by"), F.coalesce(at(4).try_cast("int"), F.lit(0)).alias("dy"), F.coalesce(at(5), F.lit("")).alias("plot"),
        at(6).try_cast("double").alias("lat"), at(7).try_cast("double").alias("lng"), F.coalesce(at(8).try_cast("int"), F.lit(0)).alias("flags"))
    return objects.unionByName(compact)


def _headers(df: DataFrame) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in df.columns:
        out.setdefault(c.strip().lower(), c)
    return out


def _pick(df: DataFrame, heads: dict[str, str], *wanted: str) -> Column | None:
    for w in wanted:
        if w in heads:
            return F.coalesce(df[f"`{heads[w]}`"], F.lit(""))
    return None


def import_requests_sheet(sheet: DataFrame) -> DataFrame:
    """A request sheet with any column order and case; ``memorialId`` is the one column it
    must have. Years come from the free-text dates."""
    h = _headers(sheet)
    if "memorialid" not in h:
        raise ValueError("not a request sheet: it has no memorialId column")
    col = lambda n: (lambda c: F.lit("") if c is None else c)(_pick(sheet, h, n))
    year = lambda n: F.nullif(dates.year_of(col(n)), F.lit(0))
    num = lambda n: F.regexp_extract(col(n), r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")
    df = sheet.select(
        _pick(sheet, h, "memorialid").try_cast("bigint").alias("mid"), col("firstname").alias("fn"), col("lastname").alias("ln"),
        F.trim(F.concat_ws(" ", col("firstname"), col("lastname"))).alias("name"), year("birthdate").alias("by"), year("deathdate").alias("dy"),
        col("birthdate").alias("bd"), col("deathdate").alias("dd"), col("plot").alias("plot"), col("notes").alias("notes"),
        col("datecreated").alias("created"), num("latitude").alias("lat"), num("longitude").alias("lng"))
    return df.filter("mid <> 0")


def import_register_sheet(sheet: DataFrame, coded: bool = False) -> DataFrame:
    """A clerk's sheet to register rows: header aliases, a plot-number code before the
    columns, bare section numbers as "Section N". ``coded``: the cemetery has section codes."""
    h = _headers(sheet)
    pick = lambda *w: _pick(sheet, h, *w)
    name, first, last = pick("name", "deceased", "deceased name", "full name", "occupant"), pick("first name", "firstname", "first"), pick("last name", "lastname", "last", "surname")
    if name is None and (first is None or last is None):
        raise ValueError("no name column found")
    full = F.trim(name) if name is not None else F.regexp_replace(F.concat(F.trim(last), F.lit(", "), F.trim(first)), r"^, |, $", "")
    txt = lambda c: F.lit("") if c is None else F.trim(c)
    sec = pick("section", "sec")
    plain = lambda c: F.lit("") if c is None else c
    df = sheet.select(
        full.alias("name"), plain(pick("birth date", "birthdate", "birth", "born", "dob")).alias("bd"),
        plain(pick("death date", "deathdate", "death", "died", "dod")).alias("dd"),
        plain(pick("burial date", "burialdate", "burial", "interment date")).alias("burial"),
        txt(pick("plot number", "plotnumber", "plot #")).alias("_code"), txt(sec).alias("_sect"),
        F.upper(txt(pick("block", "blk"))).alias("_b"), plots.strip_zeros(txt(pick("lot"))).alias("_l"), txt(pick("grave", "plot", "space")).alias("_g")).filter("name <> ''")
    df = plots.decode_code(df, "_code").withColumnsRenamed({c: f"k_{c}" for c in plots.PARTS})
    df = plots.parse_generic(df.withColumn("_t", F.concat("_sect", F.lit(" Lot 0"))), "_t").withColumnsRenamed({c: f"t_{c}" for c in plots.PARTS})
    by_table = F.lit(False)
    if coded:
        codes = plots.section_code_table(df.sparkSession)
        df = df.join(F.broadcast(codes), plots.bare_section_code(F.col("_sect")) == codes["_bare"], "left").drop(codes["_bare"])
        by_table = F.col("code_section").isNotNull()
    by_code = F.coalesce("k_section", F.lit("")) != ""
    use_cols = ~by_code & F.lit(sec is not None)
    section = F.when(by_table, F.col("code_section") if coded else F.lit("")).when(F.col("_sect").rlike(r"^\d+$"), F.concat(F.lit("Section "), plots.strip_zeros(F.col("_sect")))).otherwise(F.coalesce("t_section", "_sect"))
    out = {"section": F.when(use_cols, section).otherwise(F.coalesce("k_section", F.lit(""))), "sub": F.when(use_cols, F.when(by_table, F.col("code_sub")).otherwise("") if coded else F.lit("")).otherwise(F.coalesce("k_sub", F.lit(""))),
           "block": F.when(use_cols, F.col("_b")).otherwise(F.coalesce("k_block", F.lit(""))), "lot": F.when(use_cols, F.col("_l")).otherwise(F.coalesce("k_lot", F.lit(""))),
           "grave": F.when(use_cols, F.col("_g")).otherwise(F.coalesce("k_grave", F.lit("")))}
    return df.select("name", "bd", "dd", "burial", *[c.alias(n) for n, c in out.items()])


def import_register_text(lines: DataFrame) -> DataFrame:
    """Free-text register lines: leading "Last, First", an embedded plot code or plot words,
    first year = birth, second = death. Lines without a name are dropped. ``lines``: the
    line's keys and ``text``."""
    s = F.trim(F.col("text"))
    name = r"^([A-Z][a-zA-Z'\-]+,\s*[A-Za-z'.\- ]+?)(?:\s{2,}|\t|$)"
    code = r"\b([A-Z]+-\d+-[A-Z0-9]*-[A-Z0-9]*-?[0-9]*)\b"
    df = once(lines, {"_t": s, "name": F.trim(F.regexp_extract(s, name, 1)), "_code": F.regexp_extract(s, code, 1),
                      "_y": F.regexp_extract_all(s, F.lit(C.YEAR), F.lit(1))})
    df = df.filter((F.length("_t") >= 6) & (F.col("name") != ""))
    df = plots.decode_code(df, "_code").withColumnsRenamed({c: f"k_{c}" for c in plots.PARTS})
    df = plots.parse_generic(df, "_t").withColumnsRenamed({c: f"t_{c}" for c in plots.PARTS})
    is_code = F.col("k_section").isNotNull()
    out = {c: F.coalesce(F.when(is_code, F.col(f"k_{c}")).otherwise(F.col(f"t_{c}")), F.lit("")) for c in plots.PARTS}
    keys = [c for c in lines.columns if c != "text"]
    return df.select(*keys, "name", F.coalesce(F.get("_y", F.lit(0)), F.lit("")).alias("bd"), F.coalesce(F.get("_y", F.lit(1)), F.lit("")).alias("dd"),
                     *[v.alias(k) for k, v in out.items()])
