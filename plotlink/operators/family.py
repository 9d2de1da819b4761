"""Family lists: links by name, hints, and the best located relative."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions import names
from plotlink.functions.frames import once, union_all
from plotlink.functions.lineage import written


def _listed(memorial: DataFrame) -> DataFrame:
    """One row per memorial and distinct normalised family name."""
    df = memorial.filter("fam <> ''").select("cem_id", "ord", "mid", F.posexplode(F.split("fam", r"\|")).alias("pos", "_f"))
    df = once(df, {"kin": names.norm_name(F.col("_f"))}).drop("_f")
    return df.filter("kin <> ''").groupBy("cem_id", "ord", "mid", "kin").agg(F.min("pos").alias("pos"))


def _named(memorial: DataFrame) -> DataFrame:
    return once(memorial, {"kin": names.norm_name(F.col("name"))}).filter("kin <> ''")


def first_two(df: DataFrame, by: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """The first two rows of every group: one to use, one spare if the first is oneself."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r <= 2").select(*by, *cols)


def family_links(memorial: DataFrame) -> DataFrame:
    """Both directions of the family lists, per memorial and name: how many memorials of the
    cemetery bear (or list) it, and the first of them other than the memorial itself."""
    listed, named = _listed(memorial), _named(memorial).select("cem_id", "ord", "mid", "kin")
    by = ["cem_id", "kin"]

    def side(people, source, direction):
        size = people.groupBy(*by).agg(F.count("*").alias("_n"))
        first = first_two(people.withColumnRenamed("mid", "k_mid"), by, [F.col("ord")], ["k_mid", F.col("ord").alias("k_ord")])
        # is the memorial itself among the people? its own row must not count
        own = people.select("cem_id", "kin", "mid", F.lit(1).alias("_own"))
        return source.select("cem_id", "mid", "kin").join(size, by).join(own, ["cem_id", "kin", "mid"], "left") \
            .join(first, by).filter(F.col("k_mid") != F.col("mid")) \
            .groupBy("cem_id", "mid", "kin").agg(
                (F.max("_n") - F.coalesce(F.max("_own"), F.lit(0))).alias("n_kin"), F.min_by("k_mid", "k_ord").alias("first_kin")) \
            .withColumn("direction", F.lit(direction))

    return side(named, listed, "lists").unionByName(side(listed, named, "listed_by"))


def family_members(memorial: DataFrame) -> DataFrame:
    """Who bears and who lists every name that occurs both ways in a cemetery. With the rows of
    ``family_links`` this holds every relative, without laying out all pairs of a name."""
    by = ["cem_id", "kin"]
    bears = _named(memorial).select(*by, "mid", F.lit("bears").alias("role"))
    lists = _listed(memorial).select(*by, "mid", F.lit("lists").alias("role"))
    both = bears.unionByName(lists)
    met = both.groupBy(*by).agg(F.min("role").alias("_lo"), F.max("role").alias("_hi")).filter("_lo < _hi").select(*by)
    return both.join(met, by)


def locatable(memorial: DataFrame, located: DataFrame, gps_acc: int, levels) -> DataFrame:
    """Memorials with a place: their own pin, else their plot's place at one of ``levels``."""
    from plotlink.plans.locate import with_location

    df = with_location(memorial, located)
    pin = F.col("lat").isNotNull()
    df = df.withColumns({
        "at_lat": F.when(pin, F.col("lat")).otherwise(F.col("loc_lat")), "at_lng": F.when(pin, F.col("lng")).otherwise(F.col("loc_lng")),
        "at_acc": F.when(pin, F.lit(gps_acc)).otherwise(F.col("loc_acc")), "at_level": F.when(pin, "gps").otherwise(F.col("loc_level")),
    })
    return df.filter(F.col("at_level").isin(*levels)) if levels else df


def best_relative(request: DataFrame, memorial: DataFrame, located: DataFrame) -> DataFrame:
    """Best located relative of each request's memorial. Every name keeps only its two best
    graves, so the join from requests through names stays one-to-few for any name."""
    place = ["mid", "name", "at_lat", "at_lng", "at_acc", "section", "sub", "block", "lot", "grave", "ord"]
    kin = written(_named(locatable(memorial, located, 8, ("gps", "lot", "adjacent")))
                  .select("cem_id", "kin", F.struct(*place).alias("k")), "located-kin")
    rank = [F.col("k.at_acc"), F.col("k.ord")]
    by = ["cem_id", "kin"]
    bearing = first_two(kin, by, rank, ["k"])
    listing = first_two(_listed(memorial).drop("pos", "ord").join(
        kin.select("cem_id", F.col("k.mid").alias("mid"), "k"), ["cem_id", "mid"]), by, rank, ["k"])
    asked = request.select("cem_id", F.col("mid").alias("q_mid")).distinct()
    mem = memorial.join(asked, (memorial.cem_id == asked.cem_id) & (memorial.mid == asked.q_mid), "left_semi")
    forward = _listed(mem).select("cem_id", F.col("mid").alias("q_mid"), "kin", "pos").join(bearing, by).withColumn("dir", F.lit(0))
    back = _named(mem).select("cem_id", F.col("mid").alias("q_mid"), "kin", F.lit(0).alias("pos")).join(listing, by).withColumn("dir", F.lit(1))
    both = forward.unionByName(back).filter(F.col("k.mid") != F.col("q_mid"))
    return both.groupBy("cem_id", "q_mid").agg(F.min_by("k", F.struct("k.at_acc", "dir", "pos", "k.ord")).alias("k")).select(
        "cem_id", F.col("q_mid").alias("mid"), F.col("k.mid").alias("via_mid"), F.col("k.name").alias("via"), F.col("k.at_lat").alias("fam_lat"),
        F.col("k.at_lng").alias("fam_lng"), F.col("k.at_acc").alias("fam_acc"),
        *[F.col(f"k.{c}").alias(f"fam_{c}") for c in ("section", "sub", "block", "lot")])


def family_hints(request: DataFrame, memorial: DataFrame, located: DataFrame, limit: int = 8) -> DataFrame:
    """Up to ``limit`` leads per request: listed family first, then burials of the same
    surname (years within 40) or sound (within 5) that can be walked to or looked at.

    The year gap only depends on one year of the candidate, so each (surname, year) keeps
    its first ``2 * limit + 1`` candidates - enough even if the request itself and a full
    list of family members are among them - and a request joins at most 81 years of them."""
    people = locatable(memorial, located, 6, None).withColumns({
        "photo": F.col("flags").bitwiseAND(1) != 0, "placed": F.col("at_level").isNotNull()})
    info = F.struct(F.col("mid").alias("k_mid"), F.col("name").alias("k_name"), F.col("ord").alias("k_ord"),
                    F.col("placed").alias("k_placed"), F.col("at_level").alias("k_level"))
    # 1. listed family, both directions, in list order; one spare per name for oneself
    by = ["cem_id", "kin"]
    named = _named(people).select("cem_id", "kin", "ord", info.alias("k"))
    w = Window.partitionBy(*by).orderBy("ord")
    bearing = named.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit + 1).select(*by, "k")
    listing = _listed(memorial).join(people.select("cem_id", "mid", info.alias("k")), ["cem_id", "mid"]) \
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit + 1).select(*by, "k")
    req = request.filter("nl <> ''").select("cem_id", "ord", "mid", "nl", "sx", "by", "dy", "name")
    q = ["cem_id", "ord", "mid"]
    forward = req.select(*q).join(_listed(memorial).drop("ord"), ["cem_id", "mid"]).join(bearing, by) \
        .select(*q, "k", F.lit(0).alias("dir"), "pos")
    back = _named(req).select(*q, "kin").join(listing, by).select(*q, "k", F.lit(1).alias("dir"), F.lit(0).alias("pos"))
    fam = forward.unionByName(back).filter(F.col("k.k_mid") != F.col("mid")) \
        .groupBy(*q, "k").agg(F.min(F.struct("dir", "pos", "k.k_ord")).alias("at"))
    wq = Window.partitionBy(*q).orderBy("at")
    fam = fam.withColumn("_r", F.row_number().over(wq)).filter(F.col("_r") <= limit) \
        .select(*q, "k", F.lit(True).alias("is_family"), F.lit(True).alias("exact"), F.lit(0).alias("gap"), F.col("_r").cast("bigint").alias("seq"))
    # 2. same surname or sound, folded by the year that decides the gap
    usable = people.filter("placed OR photo")
    tok = F.array_distinct(F.filter(F.array(
        F.concat(F.lit("n:"), "nl"), F.when(F.col("nm") != "", F.concat(F.lit("n:"), "nm")), F.concat(F.lit("s:"), "sx")), lambda x: x.isNotNull()))
    years = F.filter(F.array(F.when(F.col("dy") != 0, F.concat(F.lit("d"), "dy")),
                             F.when((F.col("by") != 0) & (F.col("dy") == 0), F.concat(F.lit("x"), "by")),
                             F.when((F.col("by") != 0) & (F.col("dy") != 0), F.concat(F.lit("b"), "by"))), lambda x: x.isNotNull())
    c = usable.withColumn("tok", F.explode(tok)).withColumn("yk", F.explode(years)).withColumn("n_ok", F.col("tok").startswith("n:"))
    # a sound match that is also a name match is found under its name
    c = c.select("cem_id", "tok", "yk", "placed", "ord", "nl", "nm", info.alias("k"))
    wc = Window.partitionBy("cem_id", "tok", "yk").orderBy(F.desc("placed"), "ord")
    # sound groups are split by surname so that rows already found by name cannot crowd others out
    ws = Window.partitionBy("cem_id", "tok", "yk", "nl", "nm").orderBy(F.desc("placed"), "ord")
    few = union_all([
        c.filter(F.col("tok").startswith("n:")).withColumn("_r", F.row_number().over(wc)),
        c.filter(F.col("tok").startswith("s:")).withColumn("_r", F.row_number().over(ws)),
    ]).filter(F.col("_r") <= 2 * limit + 1).drop("_r")
    span = lambda y, tags, g: F.flatten(F.transform(F.sequence(F.lit(-g), F.lit(g)), lambda d: F.array(
        *[F.concat(F.lit(t), (y + d).cast("string")) for t in tags])))
    keys = lambda g: F.when((F.col("dy") != 0) & (F.col("by") != 0), F.concat(span(F.col("dy"), ["d"], g), span(F.col("by"), ["x"], g))) \
        .when(F.col("dy") != 0, span(F.col("dy"), ["d"], g)) \
        .when(F.col("by") != 0, span(F.col("by"), ["x", "b"], g)).otherwise(F.array().cast("array<string>"))
    rq = union_all([
        req.withColumn("tok", F.concat(F.lit("n:"), "nl")).withColumn("yk", F.explode(keys(40))),
        req.withColumn("tok", F.concat(F.lit("s:"), "sx")).withColumn("yk", F.explode(keys(5))),
    ]).withColumnRenamed("nl", "q_nl").withColumnRenamed("ord", "q_ord")
    hit = rq.join(few, ["cem_id", "tok", "yk"]).filter(F.col("k.k_mid") != F.col("mid"))
    exact = (F.col("nl") == F.col("q_nl")) | ((F.col("nm") != "") & (F.col("nm") == F.col("q_nl")))
    hit = hit.filter(F.col("tok").startswith("n:") | ~exact)
    gap = F.abs(F.substring("yk", 2, 9).cast("int") - F.when(F.col("yk").startswith("d"), F.col("dy")).otherwise(F.col("by")))
    hit = hit.select("cem_id", F.col("q_ord").alias("ord"), "mid", "k", F.lit(False).alias("is_family"), exact.alias("exact"),
                     gap.alias("gap"), F.col("k.k_ord").alias("seq"))
    hit = hit.join(fam.select(*q, F.col("k.k_mid").alias("_m")), (hit.cem_id == fam.cem_id) & (hit.ord == fam.ord)
                   & (hit["k.k_mid"] == F.col("_m")), "left_anti")
    # a full family list is shown as listed; otherwise located relatives come first
    full = fam.groupBy(*q).agg((F.count("*") >= limit).alias("full"))
    ranked = fam.unionByName(hit).join(full, q, "left").withColumn(
        "placed", F.coalesce(F.col("full"), F.lit(False)) | F.col("k.k_placed"))
    wr = Window.partitionBy(*q).orderBy(F.desc("is_family"), F.desc("exact"), "gap", F.desc("placed"), "seq")
    return ranked.withColumn("rank", F.row_number().over(wr)).filter(F.col("rank") <= limit).select(
        "cem_id", "ord", "mid", "rank", F.col("k.k_mid").alias("kin_mid"), F.col("k.k_name").alias("kin_name"),
        F.col("k.k_level").alias("level"), "gap", "exact", "is_family")
