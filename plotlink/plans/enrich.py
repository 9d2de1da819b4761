"""From open requests to places on the ground: the flagship plan."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.functions import geo
from plotlink.functions.lineage import written
from plotlink.operators.family import best_relative
from plotlink.plans.locate import with_location

PARTS = ("section", "sub", "block", "lot")


def plot_conflict(df: DataFrame, a: str = "p_", b: str = "r_") -> DataFrame:
    """Do the memorial's plot and the register's plot contradict each other? Missing parts
    and the '*' bucket never do."""
    c = lambda s, x: F.coalesce(F.col(s + x), F.lit(""))
    have = (c(a, "section") != "") & (c(b, "section") != "")
    differ = lambda x: (c(a, x) != "") & (c(b, x) != "") & (c(a, x) != c(b, x))
    section = differ("section") & (c(a, "section") != "*") & (c(b, "section") != "*")
    la, lb = c(a, "lot").try_cast("double"), c(b, "lot").try_cast("double")
    return df.withColumn("plot_conflict", have & (section | differ("sub") | differ("block") | F.coalesce(la != lb, F.lit(False))))


def request_plots(request: DataFrame, req_links: DataFrame, register: DataFrame) -> DataFrame:
    """Requests with their own plot parts (p_*), and those of their register row (r_*)."""
    ros = register.select("cem_id", "key", F.col("name").alias("ros_name"), *[F.col(c).alias(f"r_{c}") for c in PARTS])
    df = request.join(req_links.select("cem_id", "ord", "key", F.col("score").alias("ros_score"), "how"), ["cem_id", "ord"], "left") \
        .join(ros, ["cem_id", "key"], "left")
    df = df.withColumns({f"p_{c}": F.col(c) for c in PARTS}).drop(*PARTS, "grave")
    no_plot = F.coalesce("r_section", F.lit("")) == ""
    df = df.withColumn("ros_no_plot", F.col("key").isNotNull() & no_plot)
    df = df.withColumns({f"r_{c}": F.when(~no_plot, F.col(f"r_{c}")) for c in PARTS})
    return plot_conflict(df).withColumn("ros_verify", F.coalesce(F.col("ros_score").between(1, 84), F.lit(False)))


def _rank(level: str, acc: str):
    order = F.when(F.col(level) == "lot", 1).when(F.col(level) == "adjacent", 2).when(F.col(level) == "block", 3).when(F.col(level) == "section", 4)
    return F.coalesce(order * 1000 + F.col(acc), F.lit(1000000))


def enrich_requests(request: DataFrame, memorial: DataFrame, register: DataFrame, req_links: DataFrame,
                    located: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Every request with its register row, its place and how that place is known."""
    # the steps are written, so that the driver plans one at a time
    df = written(request_plots(request, req_links, register), "request-plots")
    for side in ("r_", "p_"):
        df = df.withColumns({c: F.col(side + c) for c in PARTS})
        df = with_location(df, located, f"{side}at_").drop(*PARTS)
    mem = memorial.select("cem_id", "mid", F.col("lat").alias("m_lat"), F.col("lng").alias("m_lng"), F.col("flags").alias("m_flags"), F.lit(True).alias("has_mem"))
    cem = cemetery.select("cem_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"))
    df = df.join(mem, ["cem_id", "mid"], "left").join(cem, "cem_id")
    d = geo.haversine(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"))
    has_r, has_p = F.coalesce("r_section", F.lit("")) != "", F.coalesce("p_section", F.lit("")) != ""
    df = df.withColumn("src", F.when(d.between(5, 800), "request").when(F.col("m_lat").isNotNull(), "memorial")
                       .when(_rank("r_at_level", "r_at_acc") <= _rank("p_at_level", "p_at_acc"),
                             F.when(F.col("r_at_level").isNotNull(), "register"))
                       .otherwise("plot"))
    by_src = lambda q, m, r, p: F.when(F.col("src") == "request", q).when(F.col("src") == "memorial", m) \
        .when(F.col("src") == "register", r).when(F.col("src") == "plot", p)
    n = F.lit(None)
    df = df.withColumns({
        "at_lat": by_src(F.col("lat"), F.col("m_lat"), F.col("r_at_lat"), F.col("p_at_lat")),
        "at_lng": by_src(F.col("lng"), F.col("m_lng"), F.col("r_at_lng"), F.col("p_at_lng")),
        "at_acc": by_src(F.lit(8), F.lit(8), F.col("r_at_acc"), F.col("p_at_acc")),
        "at_level": by_src(F.lit("gps"), F.lit("gps"), F.col("r_at_level"), F.col("p_at_level")),
        "at_pins": by_src(n, n, F.col("r_at_pins"), F.col("p_at_pins")),
        "at_disputed": by_src(n, n, F.col("r_at_disputed"), F.col("p_at_disputed")),
        # the plot the place came from; with a pin, the register's plot says more
        "use": F.when(F.col("src").isin("request", "memorial", "register"), F.when(has_r, "r").when(has_p, "p"))
        .otherwise(F.when(has_p, "p").when(has_r, "r")),
    })
    df = written(df, "placed-requests")
    lost = df.filter("src IS NULL AND has_mem").select("cem_id", "mid")
    df = df.join(written(best_relative(lost, memorial, located), "relatives"), ["cem_id", "mid"], "left")
    fam = F.col("src").isNull() & F.col("via").isNotNull()
    best = lambda c: F.when(F.col("use") == "r", F.col(f"r_{c}")).when(F.col("use") == "p", F.col(f"p_{c}")).when(fam, F.col(f"fam_{c}"))
    return df.withColumns({f"b_{c}": best(c) for c in PARTS}).select(
        "cem_id", "ord", "prid", "mid", "name", "fn", "ln", "by", "dy", "plot", "claimed", "problem", "created", "key", "ros_score", "how", "ros_verify", "ros_no_plot", "plot_conflict",
        *[F.col(f"r_{c}") for c in PARTS], *[f"b_{c}" for c in PARTS],
        F.when(fam, F.col("fam_lat")).otherwise(F.col("at_lat")).alias("lat"),
        F.when(fam, F.col("fam_lng")).otherwise(F.col("at_lng")).alias("lng"),
        F.when(fam, F.greatest(F.lit(10), F.col("fam_acc") + 4)).otherwise(F.col("at_acc")).alias("acc"),
        F.when(fam, F.lit("family")).otherwise(F.col("at_level")).alias("level"),
        F.col("at_pins").alias("pins"), F.coalesce("at_disputed", F.lit(False)).alias("disputed"),
        F.when(fam, F.col("via")).alias("via"), (F.col("m_flags").bitwiseAND(4) != 0).alias("veteran"))
