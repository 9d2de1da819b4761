"""Work lists, counts, search and walking order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import geo, names
from plotlink.functions.frames import once, union_all
from plotlink.functions.lineage import written
from plotlink.functions.order import pick_at, ranked

FINISHED = ("done", "nostone", "notfound")


def _status(df: DataFrame, progress: DataFrame) -> DataFrame:
    p = progress.select(F.col("pk").try_cast("bigint").alias("mid"), F.coalesce("st", F.lit("")).alias("st"),
                        F.coalesce("up", F.lit(False)).alias("up"), "ts").filter("mid IS NOT NULL")
    return df.join(p, "mid", "left").withColumn("finished", F.coalesce(F.col("st").isin(*FINISHED), F.lit(False)))


def years_label(by: Column, dy: Column) -> Column:
    part = lambda y: F.when(F.coalesce(y, F.lit(0)) == 0, "?").otherwise(y.cast("string"))
    return F.when((F.coalesce(by, F.lit(0)) == 0) & (F.coalesce(dy, F.lit(0)) == 0), "").otherwise(F.concat(part(by), F.lit("–"), part(dy)))


def _enc(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def research_leads(fn: Column, ln: Column, dy: Column, veteran: Column) -> Column:
    """Where to look next, by era: array of (label, query)."""
    full = _enc(F.trim(F.concat_ws(" ", fn, ln)))
    lead = lambda label, q: F.struct(F.lit(label).alias("label"), q.alias("query"))
    known = F.coalesce(dy, F.lit(0)) != 0
    return F.filter(F.array(
        F.when(known, lead("death record", F.concat_ws("&", _enc(fn), _enc(ln), (dy - 2).cast("string"), (dy + 2).cast("string")))),
        F.when(known & (dy <= 1963), lead("newspaper", F.concat_ws("&", full, dy.cast("string"), F.least(dy + 1, F.lit(1963)).cast("string")))),
        F.when(F.coalesce(veteran, F.lit(False)), lead("veteran locator", F.lit(""))),
        lead("web", F.when(known, F.concat_ws("+", full, dy.cast("string"))).otherwise(full)),
    ), lambda x: x.isNotNull())


def request_worklist(enriched: DataFrame, sizes: DataFrame, as_of: str) -> DataFrame:
    """One row per request: how sure its place is or why it has none, labels, flags, leads.
    ``sizes``: memorials per cemetery; ``as_of``: the date ages are counted to."""
    df = enriched.join(sizes.select("cem_id", "n_memorials"), "cem_id", "left")
    has_text = (F.coalesce("plot", F.lit("")) != "") & ~F.col("plot").rlike(r"(?i)no location|unknown")
    reason = F.when(F.col("ros_no_plot"), "register has no plot").when(has_text, "plot not mappable") \
        .when(F.col("n_memorials").between(1, 400), "small cemetery").otherwise("no plot")
    cls = F.when(F.col("level").isin("gps", "lot"), "lot").when(F.col("level").isin("adjacent", "block"), "block").otherwise("section")
    year = F.regexp_extract("created", r"\b(20\d\d)\b", 1)
    age = F.datediff(F.lit(as_of).cast("date"), F.col("created").try_cast("date"))
    return df.select(
        "cem_id", "mid", F.when(F.col("level").isNull(), reason).otherwise(cls).alias("confidence"),
        F.when(F.col("level").isNotNull(), F.concat(F.lit("±"), geo.half_up(F.col("acc") * 3.28084).cast("string"), F.lit(" ft"))).alias("acc_label"),
        years_label(F.col("by"), F.col("dy")).alias("years"), (F.col("claimed") != "").alias("claimed"),
        F.col("plot_conflict").alias("verify_plot"), F.col("ros_verify").alias("verify_register"),
        ((year != "") & F.coalesce(age > 550, F.lit(False))).alias("long_open"), F.coalesce("veteran", F.lit(False)).alias("veteran"),
        F.trim(F.regexp_replace("problem", r"\s+", " ")).alias("problem"),
        research_leads(F.col("fn"), F.col("ln"), F.col("dy"), F.col("veteran")).alias("leads"))


def header_stats(request: DataFrame, progress: DataFrame, active: list[int]) -> DataFrame:
    df = _status(request.select("cem_id", "mid"), progress)
    here = F.col("cem_id").isin(*active)
    return df.agg(F.count_if(~F.col("finished")).alias("open"), F.count_if("finished").alias("done"),
                  F.count_if(~F.col("finished") & here).alias("open_here"))


def finished_work(request: DataFrame, progress: DataFrame, memorial: DataFrame) -> DataFrame:
    """Finished graves with their stage: still to upload, uploaded, confirmed, other."""
    from plotlink.operators.burials import fulfilled_requests

    mine = _status(request.select("cem_id", "mid", "name"), progress).filter("finished") \
        .select("cem_id", "mid", "name", "st", "up", "ts", F.lit(False).alias("gone"))
    gone = fulfilled_requests(progress, request, memorial).select("cem_id", "mid", "name", "st", F.lit(False).alias("up"), "ts", F.lit(True).alias("gone"))
    stage = F.when(F.col("gone"), "confirmed").when((F.col("st") == "done") & F.col("up"), "uploaded").when(F.col("st") == "done", "to_upload").otherwise("closed")
    return mine.unionByName(gone).withColumn("stage", stage).drop("gone")


def finish_stages(request: DataFrame, progress: DataFrame, memorial: DataFrame) -> DataFrame:
    """Finished work per stage, with the newest entry of each."""
    return finished_work(request, progress, memorial).groupBy("stage").agg(
        F.count("*").alias("n"), F.max("ts").alias("newest_ts"), F.max_by("mid", F.struct("ts", "mid")).alias("newest_mid"))


def photo_queue(photos: DataFrame, progress: DataFrame, from_ms: int, to_ms: int, hide_uploaded: bool = True) -> DataFrame:
    """Photos between two days (the last one included): count, MB, and how many photos
    overall belong to graves already marked uploaded."""
    up = progress.filter("up").select(F.col("pk").alias("base"), F.lit(True).alias("is_up"))
    df = photos.withColumn("base", F.substring_index("pk", "#", 1)).join(up, "base", "left")
    is_up = F.coalesce("is_up", F.lit(False))
    within = (F.col("ts") >= from_ms) & (F.col("ts") < to_ms + 86400000)
    shown = within & ~is_up if hide_uploaded else within
    return df.agg(F.count_if(shown).alias("n"), F.round(F.sum(F.when(shown, F.col("size")).otherwise(0)) / 1048576, 1).alias("mb"),
                  F.count_if(is_up).alias("n_uploaded"))


def section_groups(enriched: DataFrame, progress: DataFrame) -> DataFrame:
    sec = F.coalesce("b_section", F.lit(""))
    label = F.when(sec == "", "No plot on record").when(sec == "*", "Rows & lots (no section names here)") \
        .when((sec == "Old Part") & (F.coalesce("b_sub", F.lit("")) != ""), F.concat(sec, F.lit(" — Sub "), F.col("b_sub"))).otherwise(sec)
    df = _status(enriched.select("cem_id", "mid", label.alias("label")), progress)
    return df.groupBy("cem_id", "label").agg(F.count_if(~F.col("finished")).alias("open"), F.count("*").alias("total"))


def section_histogram(register: DataFrame) -> DataFrame:
    """Rows per section and the share of the cemetery's rows that have a position at all."""
    by = register.groupBy("cem_id", F.when(F.col("section") == "", "(none)").otherwise(F.col("section")).alias("label")).agg(F.count("*").alias("n"))
    cem = by.groupBy("cem_id").agg(F.sum("n").alias("n_cem"), F.sum(F.when(F.col("label") != "(none)", F.col("n")).otherwise(0)).alias("n_placed"))
    return by.join(cem, "cem_id").select("cem_id", "label", "n", geo.half_up(F.expr("100 * n_placed / n_cem")).cast("int").alias("located_pct"))


def round_trip_error(memorial: DataFrame, located: DataFrame, cemetery: DataFrame) -> DataFrame:
    """How far pinned memorials land from their own pins when located by plot alone."""
    from plotlink.plans.locate import with_location

    df = with_location(memorial.filter("lat IS NOT NULL AND section IS NOT NULL"), located).filter("loc_level IS NOT NULL AND loc_level <> 'section'")
    df = df.withColumn("err", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("loc_lat"), F.col("loc_lng")), 2))
    mid = pick_at(df, ["cem_id"], "err", F.floor(F.col("n") / 2), "median")
    p90 = pick_at(df, ["cem_id"], "err", F.floor(F.col("n") * 0.9), "p90").drop("n")
    return mid.join(p90, "cem_id")


# ---------------------------------------------------------------- search

def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _matching(hay: Column, queries: list[str], norm, least: int) -> Column:
    """Indexes of the queries, normalised like the text by ``norm`` and then at least ``least``
    characters long, all of whose terms occur in the text (queries are a handful of typed
    strings, so this stays one projection)."""
    hits = []
    for i, q in enumerate(queries):
        typed = norm(F.lit(q))
        hits.append(F.when((F.char_length(typed) >= least) & F.forall(F.split(typed, " "), lambda t: F.contains(hay, t)), F.lit(i)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def search_burials(memorial: DataFrame, register: DataFrame, linked: DataFrame, queries: list[str], limit: int = 60) -> DataFrame:
    """First ``limit`` hits per cemetery and query: memorials first, then register rows that
    no memorial stands for. Queries are normalised like names, then shorter than two letters find
    nothing; the typed text is reported."""
    mem = memorial.select("cem_id", F.lit("mem").alias("kind"), F.col("mid").alias("id"), "ord", "name", "sk")
    ros = register.join(linked.select("cem_id", "key"), ["cem_id", "key"], "left_anti") \
        .select("cem_id", F.lit("ros").alias("kind"), F.col("key").alias("id"), "ord", "name", "sk")
    df = mem.unionByName(ros).withColumn("qi", F.explode(_matching(F.col("sk"), queries, names.norm_name, 2)))
    w = Window.partitionBy("qi", "cem_id").orderBy("kind", "ord")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit) \
        .withColumn("query", F.get(F.array(*[F.lit(q) for q in queries]), F.col("qi"))).select("query", "cem_id", "rank", "kind", "id", "name")


def search_all(memorial: DataFrame, register: DataFrame, linked: DataFrame, queries: list[str], per_cem: int = 6, total: int = 120) -> DataFrame:
    """Across cemeteries in order: at most ``per_cem`` each, whole cemeteries until ``total``
    is reached; ``truncated`` tells that something was left out."""
    hits = search_burials(memorial, register, linked, queries, per_cem + 1)
    per = hits.groupBy("query", "cem_id").agg(F.least(F.count("*"), F.lit(per_cem)).alias("n"), (F.count("*") > per_cem).alias("more"))
    w = Window.partitionBy("query").orderBy("cem_id").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("cum", F.sum("n").over(w))
    flag = run.groupBy("query").agg(F.max(F.when(F.col("cum") - F.col("n") < total, F.col("more")).otherwise(False)).alias("more"), F.max("cum").alias("all"))
    flag = flag.select("query", (F.col("more") | (F.col("all") >= total)).alias("truncated"))
    shown = run.filter(F.col("cum") - F.col("n") < total).select("query", "cem_id")
    return hits.filter(F.col("rank") <= per_cem).join(shown, ["query", "cem_id"]).join(flag, "query")


def filter_requests(enriched: DataFrame, progress: DataFrame, queries: list[str], hide_done: bool = True) -> DataFrame:
    text = F.concat_ws(" ", F.concat_ws(" ", "name", "plot"), F.when(F.col("r_section").isNotNull(), F.concat_ws(" ", "r_section", "r_block", "r_lot")))
    df = once(enriched, {"hay": _plain(text)})
    df = _status(df, progress)
    if hide_done:
        df = df.filter("NOT finished")
    return df.withColumn("qi", F.explode(_matching(F.col("hay"), queries, _plain, 0))) \
        .withColumn("query", F.get(F.array(*[F.lit(q) for q in queries]), F.col("qi"))).select("query", "cem_id", "mid", "name")


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    s = F.regexp_replace(F.lower(c), r"([0-9]+)", "0000000000$1")
    return F.regexp_replace(s, r"0*([0-9]{10})([^0-9]|$)", "$1$2")


def walk_order(enriched: DataFrame, mode: str, position=None, section_order=()) -> DataFrame:
    """Rank of every request within its cemetery for one of the list's sort modes."""
    if mode == "name":
        keys = [names.norm_name(F.col("ln"))]
    elif mode == "conf":
        rank = F.lit(9)
        for i, level in reversed(list(enumerate(["gps", "lot", "adjacent", "block", "section", "family"]))):
            rank = F.when(F.col("level") == level, i).otherwise(rank)
        keys = [rank]
    elif mode == "near":
        keys = [F.coalesce(F.round(geo.haversine(F.lit(position[0]), F.lit(position[1]), F.col("lat"), F.col("lng")), 2), F.lit(1e9))]
    elif mode == "route":
        sec = F.coalesce("b_section", F.lit(""))
        given = F.lit(99)
        for i, s in enumerate(section_order):
            given = F.when(sec == s, i).otherwise(given)
        from plotlink.functions.plots import int_prefix

        keys = [given, F.when(sec == "*", 0).when(sec == "", 1).otherwise(2), natural_key(sec),
                natural_key(F.coalesce("b_block", F.lit(""))), F.coalesce(int_prefix(F.col("b_lot")), F.lit(9999))]
    else:
        raise ValueError(f"unknown sort mode {mode}")
    keyed = once(enriched, {f"_k{i}": k for i, k in enumerate(keys)})
    cols = [f"_k{i}" for i in range(len(keys))]
    return ranked(keyed, ["cem_id"], [*cols, "ord"]).drop(*cols)


def walk_preview(enriched: DataFrame, cemetery: DataFrame, n: int = 4) -> DataFrame:
    """Cemeteries by distance from home with their first ``n`` requests and the rest's count."""
    size = enriched.groupBy("cem_id").agg(F.count("*").alias("n_open"))
    w = Window.partitionBy("cem_id").orderBy("ord")
    first = enriched.select("cem_id", "ord", "mid", "name").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    cems = cemetery.join(size, "cem_id").select("cem_id", "miles", "n_open")
    return first.join(cems, "cem_id").select("miles", "cem_id", "rank", "mid", "name", "n_open", F.greatest(F.col("n_open") - n, F.lit(0)).alias("n_more"))


def map_layers(memorial: DataFrame, register: DataFrame, register_pins: DataFrame, linked: DataFrame, located: DataFrame, plat: DataFrame,
               burial: DataFrame, section: DataFrame, enriched: DataFrame, progress: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Every point the map draws, one row each."""
    from plotlink.operators.burials import lot_occupants
    from plotlink.plans.locate import with_location

    cem = cemetery.select("cem_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    row = lambda df, layer, id_, label, cls, n=None, soft=None: df.select(
        F.lit(layer).alias("layer"), "cem_id", id_.cast("string").alias("id"), "lat", "lng", label.alias("label"), F.lit(cls).alias("cls") if isinstance(cls, str) else cls.alias("cls"),
        (n if n is not None else F.lit(None)).cast("bigint").alias("n"), (soft if soft is not None else F.lit(False)).alias("soft"))
    near = geo.haversine(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng")).between(5, 800)
    pins = memorial.filter("lat IS NOT NULL").join(cem, "cem_id").filter(near) \
        .groupBy("cem_id", F.round("lat", 6).alias("_a"), F.round("lng", 6).alias("_b")) \
        .agg(F.min_by(F.struct("mid", "lat", "lng", "last", "field_pin"), "ord").alias("f")).select("cem_id", "f.*")
    graves = row(pins, "grave", F.col("mid"), F.col("last"), F.when(F.col("field_pin"), "pin").otherwise("memorial"))
    drawn = linked.join(memorial.filter("lat IS NOT NULL").select("cem_id", "mid"), ["cem_id", "mid"]).select("cem_id", "key")
    open_reg = register.filter("section <> ''").join(drawn, ["cem_id", "key"], "left_anti")
    pinned = register_pins.filter("section <> ''").join(drawn, ["cem_id", "key"], "left_anti")
    fixed = row(pinned, "register", F.col("key"), F.col("last"), "pin")
    placed = with_location(open_reg.join(register_pins.select("cem_id", "key"), ["cem_id", "key"], "left_anti"), located) \
        .filter(F.col("loc_level").isin("lot", "adjacent")).withColumns({"lat": F.col("loc_lat"), "lng": F.col("loc_lng")})
    reg = row(placed, "register", F.col("key"), F.col("last"), "register")
    occ = lot_occupants(plat, burial).groupBy("cem_id", "section", "sub", "block", "lot").agg(F.count("*").alias("occ"))
    lots = plat.join(cem, "cem_id").withColumns({"lat": geo.to_lat(F.col("n"), F.col("clat")), "lng": geo.to_lng(F.col("e"), F.col("clat"), F.col("clng"))}) \
        .join(occ, ["cem_id", "section", "sub", "block", "lot"], "left")
    lots = row(lots, "lot", F.concat_ws("|", "section", "block", "lot"), F.col("lot"), "lot", F.coalesce("occ", F.lit(0)))
    secs = row(section.filter("section <> '*'"), "section", F.col("section"), F.col("section"), "section")
    tgt = _status(enriched.filter("lat IS NOT NULL"), progress)
    st = F.coalesce("st", F.lit(""))
    tgt = row(tgt, "target", F.col("mid"), F.col("ln"), F.when(st == "done", "done").when(st != "", "tried").otherwise("open"), None, F.col("level").isin("family", "section"))
    # each layer is written, so that the driver plans one at a time
    return union_all([written(layer, "layer") for layer in (graves, fixed, reg, lots, secs, tgt)])
