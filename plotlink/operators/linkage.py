"""Record linkage between registers, memorials and requests.

Rows are first folded into *profiles* (rows equal in everything the score reads), so a group
of copies costs one row however large it is. A pair can only reach the lowest score that
matters through shared evidence (first name, a year within one, the same plot), so profiles
meet on surname *plus* evidence keys in plain equi joins, never on the surname alone. A pair
that meets on several keys is kept on the first of them, which needs no extra shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions import plots
from plotlink.functions.frames import once, union_all
from plotlink.functions.lineage import checkpointed, written
from plotlink.operators.georef import connected

NAME_COLS = ["nl", "sx", "nm", "cf", "fr", "by", "dy", "dyb"]
PLOT_COLS = ["section", "block", "lot"]
#: What the same lot of a block adds to the score of a pair.
SAME_LOT = 22


def profiles(df: DataFrame, side: str, key: str, with_plot: bool = True) -> DataFrame:
    """One row per distinct combination of scored columns: row count and first row."""
    df = df.withColumn("lot", F.when(F.col("lot").rlike(r"^\d+$"), plots.strip_zeros(F.col("lot"))).otherwise(F.upper("lot"))) \
        if with_plot else df.withColumns({c: F.lit(None).cast("string") for c in PLOT_COLS})
    cols = NAME_COLS + PLOT_COLS
    agg = df.groupBy("cem_id", *cols).agg(
        F.count("*").alias(f"{side}_n"),
        F.min("ord").alias(f"{side}_ord"),
        F.min_by(key, "ord").alias(f"{side}_{key}"),
    )
    return agg.select("cem_id", f"{side}_n", f"{side}_ord", f"{side}_{key}", *[F.col(c).alias(f"{side}_{c}") for c in cols])


def score(r: str, m: str) -> Column:
    """Additive agreement score of a register-side row ``r`` and a memorial-side row ``m``."""
    a = lambda c: F.col(f"{r}_{c}")
    b = lambda c: F.col(f"{m}_{c}")
    exact = (a("nl") != "") & (
        (a("nl") == b("nl")) | ((b("nm") != "") & (a("nl") == b("nm"))) | ((a("nm") != "") & (a("nm") == b("nl")))
    )
    initial = F.left(a("fr"), F.lit(1)) == F.left(b("fr"), F.lit(1))
    prefix = (a("fr") != "") & (b("fr") != "") & (a("fr").startswith(b("fr")) | b("fr").startswith(a("fr")))
    near = (F.length(a("fr")) >= 4) & (F.length(b("fr")) >= 4) & initial & (F.levenshtein(a("fr"), b("fr"), 2) >= 0)
    one = (F.length(a("fr")) == 1) | (F.length(b("fr")) == 1)
    first = F.when((a("cf") == "") | (b("cf") == ""), 0) \
        .when((a("cf") == b("cf")) | (a("fr") == b("fr")), 30) \
        .when(prefix, 20).when(near, 22) \
        .when(one, F.when(initial, 6).otherwise(0)) \
        .when(initial, 2).otherwise(-40)
    soft = a("dyb") | b("dyb")

    def years(c, same, one_off, far):
        gap = F.abs(a(c) - b(c))
        return F.when((a(c) == 0) | (b(c) == 0), 0).when(gap == 0, same).when(gap == 1, one_off) \
            .when(gap <= 3, 2).otherwise(far)

    birth = years("by", 25, 15, -20)
    death = years("dy", F.when(soft, 18).otherwise(25), F.when(soft, 12).otherwise(15), F.when(soft, -8).otherwise(-20))
    known = lambda c: F.coalesce(c, F.lit("")).isin("", "*")
    same_lot = (a("block") != "") & (a("block") == b("block")) & (a("lot") != "") & (a("lot") == b("lot"))
    place = F.when(known(a("section")) | known(b("section")), 0) \
        .when(a("section") != b("section"), -10).when(same_lot, 30).otherwise(8)
    return F.when(exact, 30 + first + birth + death + place) \
        .when(a("sx") == b("sx"), 18 + first + birth + death + place).otherwise(0)


def _evidence(side: str, spread: bool, with_plot: bool, lots: bool = True):
    """Evidence name -> array of key texts for one side; years spread to +-1 on one side. Without ``lots`` a block is a plot."""
    v = lambda c: F.col(f"{side}_{c}")
    none = F.array().cast("array<string>")

    def year(c):
        ys = [v(c) - 1, v(c), v(c) + 1] if spread else [v(c)]
        return F.when(v(c) != 0, F.array(*[y.cast("string") for y in ys])).otherwise(none)

    # births over three years apart cost what only other evidence, keyed itself, makes good again; an
    # unknown birth meets every other ("any"), a known one meets an unknown one ("none")
    reach = [(v("by") + i).cast("string") for i in range(-3, 4)] if spread else [v("by").cast("string")]
    births = F.when(v("by") != 0, F.array(*reach, F.lit("none" if spread else "any"))).otherwise(F.array(*([F.lit("any")] if spread else [F.lit("none"), F.lit("any")])))
    under = lambda head, ys: F.transform(ys, lambda y: F.concat_ws("|", head, y))
    initial = F.left(v("fr"), F.lit(1))
    out = {
        "cf": F.when(v("cf") != "", under(v("cf"), births)).otherwise(none),
        "by": year("by"),
        "dy": year("dy"),
        "init_by": F.when((v("fr") != "") & (v("by") != 0), under(initial, F.array(*reach))).otherwise(none),
    }
    if with_plot:
        ok = (v("section") != "") & (v("section") != "*") & (v("block") != "")
        out["plot"] = F.when(ok & (v("lot") != "") if lots else ok, F.array(F.concat_ws("|", v("section"), v("block"), *([v("lot")] if lots else [])))).otherwise(none)
        placed = (v("fr") != "") & (v("section") != "") & (v("section") != "*")
        out["init_section"] = F.when(placed, F.array(F.concat_ws("|", initial, v("section")))).otherwise(none)
    return out


# how surnames meet: (name, left column, right column, evidence it needs)
_ALL = ("cf", "by", "dy", "plot", "init_by", "init_section")
_MEET = [
    ("sound", "sx", "sx", ("cf", "by", "dy", "plot")),
    ("name", "nl", "nl", ("init_by", "init_section")),
    ("maiden", "nl", "nm", _ALL),
    ("former", "nm", "nl", _ALL),
]


def _kinds(with_plot: bool, initials: bool = True, meets: tuple = ("sound", "name", "maiden", "former")):
    """Every wanted (surname relation, evidence) pair with its number; lower numbers keep the pair."""
    known = [(m, e) for m in _MEET for e in m[3] if m[0] in meets and (with_plot or e not in ("plot", "init_section")) and (initials or not e.startswith("init"))]
    return list(enumerate(known))


def _tagged(values: Column, kind: int, surname: Column) -> Column:
    return F.transform(values, lambda k: F.struct(F.lit(kind).alias("kind"), F.concat_ws("|", surname, k).alias("bkey")))


def _keyed(df: DataFrame, side: str, which: int, spread: bool, with_plot: bool, kinds: list, lots: bool = True) -> DataFrame:
    # each evidence is worked out once, however many surname relations need it
    wanted = {e for _, (_, e) in kinds}
    ev = {e: F.col(f"_ev_{e}") for e in wanted}
    columns = df.columns
    df = once(df, {f"_ev_{e}": keys for e, keys in _evidence(side, spread, with_plot, lots).items() if e in wanted})
    keys = []
    for kind, (meet, e) in kinds:
        surname = F.col(f"{side}_{meet[which]}")
        # empty surnames agree by sound alone, as two blank sound codes do
        usable = F.lit(True) if meet[0] == "sound" else surname != ""
        keys.append(F.when(usable, _tagged(ev[e], kind, surname)))
    return df.select(*columns, F.inline(F.flatten(F.filter(F.array(*keys), lambda k: k.isNotNull()))))


def _first_meeting(left: str, right: str, kinds: list, lots: bool = True) -> Column:
    a = lambda c: F.col(f"{left}_{c}")
    b = lambda c: F.col(f"{right}_{c}")
    near = lambda c: (a(c) != 0) & (b(c) != 0) & (F.abs(a(c) - b(c)) <= 1)
    placed = (a("section") != "") & (a("section") != "*")
    known = placed & (a("block") != "") & (a("section") == b("section")) & (a("block") == b("block"))
    born = (a("by") != 0) & (b("by") != 0) & (F.abs(a("by") - b("by")) <= 3)
    initial = (a("fr") != "") & (F.left(a("fr"), F.lit(1)) == F.left(b("fr"), F.lit(1)))
    holds = {
        "cf": (a("cf") != "") & (a("cf") == b("cf")) & ((a("by") == 0) | (b("by") == 0) | born),
        "by": near("by"),
        "dy": near("dy"),
        "plot": known & (a("lot") != "") & (a("lot") == b("lot")) if lots else known,
        "init_by": initial & born,
        "init_section": initial & placed & (a("section") == b("section")),
    }
    out = F
    for kind, ((name, lc, rc, _), e) in kinds:
        meets = a(lc) == b(rc) if name == "sound" else (a(lc) != "") & (a(lc) == b(rc))
        out = out.when(meets & holds[e], kind)
    return out


def scored_profiles(left: DataFrame, right: DataFrame, l: str, r: str, floor: int, with_plot: bool = True, lots: bool = True, **wanted) -> DataFrame:
    """Profile pairs whose score reaches ``floor`` (at least 55), each exactly once; ``wanted``
    narrows the kinds of meeting to those that can reach it. Without ``lots`` a pair of one
    block (``one_block``) is kept if it can reach it where the lots agree."""
    if floor < C.LINK_MAYBE:
        raise ValueError("the evidence keys are complete only for scores of 55 and more")
    kinds = _kinds(with_plot, **wanted)
    # a small table's keys are many times its size, which is all Spark sees of them: they are never broadcast
    pairs = _keyed(left, l, 1, True, with_plot, kinds, lots).join(_keyed(right, r, 2, False, with_plot, kinds, lots).hint("merge"), ["cem_id", "kind", "bkey"])
    # kept apart from the join, where it would be part of one method too long to be compiled
    pairs = once(pairs.drop("bkey"), {"_first": _first_meeting(l, r, kinds, lots)}).filter("kind = _first")
    if not lots:
        met = F.expr(f"{l}_section = {r}_section AND {l}_section NOT IN ('', '*') AND {l}_block = {r}_block AND {l}_block <> ''")
        return once(pairs.drop("kind", "_first"), {"score": score(l, r), "one_block": F.coalesce(met, F.lit(False))}) \
            .filter(F.col("score") + F.when(F.col("one_block"), SAME_LOT).otherwise(0) >= floor)
    return once(pairs.drop("kind", "_first"), {"score": score(l, r)}).filter(F.col("score") >= floor)


def block_candidates(register: DataFrame, memorial: DataFrame) -> DataFrame:
    """Which surnames can pair within a cemetery, and how many row pairs each combination
    stands for. The row pairs themselves are never laid out."""
    fold = lambda df, s: df.groupBy("cem_id", "nl", "sx", "nm").agg(F.count("*").alias(f"{s}_n")) \
        .select("cem_id", f"{s}_n", *[F.col(c).alias(f"{s}_{c}") for c in ("nl", "sx", "nm")])
    tokens = lambda s: F.array_distinct(F.filter(F.array(
        F.concat(F.lit("n:"), F.col(f"{s}_nl")), F.concat(F.lit("s:"), F.col(f"{s}_sx")),
        F.when(F.col(f"{s}_nm") != "", F.concat(F.lit("n:"), F.col(f"{s}_nm")))), lambda x: x.isNotNull()))
    r = fold(register, "r").withColumn("tok", F.explode(tokens("r")))
    m = fold(memorial, "m").withColumn("tok", F.explode(tokens("m")))
    return r.join(m, ["cem_id", "tok"]).drop("tok").dropDuplicates() \
        .withColumn("n_pairs", F.col("r_n") * F.col("m_n"))


def score_pairs(register: DataFrame, memorial: DataFrame, floor: int = C.LINK_MAYBE) -> DataFrame:
    return scored_profiles(profiles(register, "r", "key"), profiles(memorial, "m", "mid"), "r", "m", floor)


def _rank_tier() -> Column:
    """Candidate order: same name or maiden name, then same sound, then former name."""
    return F.when((F.col("r_nl") == F.col("m_nl")) | ((F.col("m_nm") != "") & (F.col("r_nl") == F.col("m_nm"))), 0) \
        .when(F.col("r_sx") == F.col("m_sx"), 1).otherwise(2)


def best_two(scored: DataFrame, by: list[str], value: str, copies: str, tier: Column, ordinal: str) -> DataFrame:
    """Best pair per group with the runner-up's score (0 when there is none). ``copies``
    counts the rows behind a candidate: a second copy of the best is its own runner-up.

    Pairs are first folded by score with plain numeric aggregates, which combine before the
    shuffle; a group then has at most one row per distinct score left."""
    order = tier.cast("bigint") * F.lit(1 << 56) + F.col(ordinal)
    fold = scored.withColumn("_o", order).groupBy(*by, "score").agg(
        F.sum(copies).alias("n"), F.min_by(value, "_o").alias("v"))
    tops = F.reverse(F.array_sort(F.collect_list(F.struct("score", "n", "v"))))
    top = fold.groupBy(*by).agg(tops.alias("t")).withColumns({"_1": F.get("t", F.lit(0)), "_2": F.get("t", F.lit(1))})
    return top.select(*by, F.col("_1.score").alias("score"), F.col("_1.v").alias(value),
                      F.when(F.col("_1.n") > 1, F.col("_1.score")).otherwise(F.coalesce("_2.score", F.lit(0))).alias("second"))


def _without_lots(prof: DataFrame, side: str, key: str) -> DataFrame:
    """One row per profile but for the lot, with a number of its own; ``lots`` holds the profiles: lot, first row and count."""
    cols = [f"{side}_{c}" for c in NAME_COLS + PLOT_COLS if c != "lot"]
    lot = F.struct(F.col(f"{side}_ord").alias("ord"), F.coalesce(f"{side}_lot", F.lit("")).alias("lot"), F.col(f"{side}_n").alias("n"), F.col(f"{side}_{key}").alias("id"))
    folded = prof.groupBy("cem_id", *cols).agg(F.collect_list(lot).alias("lots"), F.sum(f"{side}_n").alias(f"{side}_n"))
    return written(folded.withColumns({f"{side}_id": F.monotonically_increasing_id(), f"{side}_lot": F.lit("")}), "blocks-of-profiles")


def candidates(prof: DataFrame, memorials: DataFrame, floor: int) -> DataFrame:
    """cem_id, r_ord, score, tier, m_n, m_ord, m_mid: the memorials of each register profile that reach ``floor``, folded by
    score and tier as far as lots don't tell them apart.

    Lots number far more profiles than names, years and blocks do, and count only within one block. So profiles meet
    without them, and lots are laid out for pairs of one block alone."""
    r, m = _without_lots(prof, "r", "key"), _without_lots(memorials, "m", "mid")
    dated = F.array_sort(F.filter("lots", lambda x: x["ord"].isNotNull()))
    m_lots = m.select("m_id", F.inline("lots")).filter("lot <> ''").select("m_id", "lot", F.col("n").alias("same_n"), F.col("ord").alias("same_ord"), F.col("id").alias("same_mid"))
    r_lots = r.select("r_id", F.inline("lots")).select("r_id", "lot", F.col("ord").alias("r_ord"))
    m = m.withColumn("_d", dated).withColumn("first", F.get("_d", F.lit(0))) \
        .withColumn("other", F.get(F.filter("_d", lambda x: x["lot"] != F.col("first")["lot"]), F.lit(0))).drop("lots", "_d")
    pairs = scored_profiles(r.drop("lots"), m, "r", "m", floor, lots=False).select(
        "cem_id", "r_id", "m_id", "score", "one_block", _rank_tier().alias("tier"), "m_n", "first", "other")
    pairs = written(pairs, "block-pairs")
    out = ["cem_id", "r_ord", "score", "tier", "m_n", "m_ord", "m_mid"]
    apart = pairs.filter("not one_block").groupBy("cem_id", "r_id", "score", "tier").agg(
        F.sum("m_n").alias("m_n"), F.min("first.ord").alias("m_ord"), F.min_by("first.id", "first.ord").alias("m_mid"))
    near = pairs.filter("one_block").join(r_lots, "r_id").join(m_lots, ["m_id", "lot"], "left")
    rest = F.when(F.col("first.lot") == F.col("lot"), F.col("other")).otherwise(F.col("first"))
    rest = F.when(F.col("lot") == "", F.col("first")).otherwise(rest)
    both = F.array(
        F.struct((F.col("score") + SAME_LOT).alias("score"), F.col("same_n").alias("m_n"), F.col("same_ord").alias("m_ord"), F.col("same_mid").alias("m_mid")),
        F.struct(F.col("score"), (F.col("m_n") - F.coalesce("same_n", F.lit(0))).alias("m_n"), rest["ord"].alias("m_ord"), rest["id"].alias("m_mid")))
    near = near.select("cem_id", "r_ord", "tier", F.inline(both)).filter((F.col("m_n") > 0) & (F.col("score") >= floor))
    return near.select(*out).unionByName(apart.join(r_lots, "r_id").select(*out))


def _profile_key(side):
    return ["cem_id"] + [f"{side}_{c}" for c in NAME_COLS + PLOT_COLS]


def rows_of_profiles(rows: DataFrame, decided: DataFrame, side: str, with_plot: bool = True) -> DataFrame:
    """Brings a decision taken per profile back to every row of the profile."""
    norm_lot = F.when(F.col("lot").rlike(r"^\d+$"), plots.strip_zeros(F.col("lot"))).otherwise(F.upper("lot"))
    cols = {f"{side}_{c}": F.col(c) for c in NAME_COLS}
    if with_plot:
        cols |= {f"{side}_section": F.col("section"), f"{side}_block": F.col("block"), f"{side}_lot": norm_lot}
        on = _profile_key(side)
    else:
        on = ["cem_id"] + [f"{side}_{c}" for c in NAME_COLS]
    return rows.withColumns(cols).join(decided, on).drop(*[c for c in on if c != "cem_id"])


def link_register_memorial(register: DataFrame, memorial: DataFrame, accept: int = C.LINK_ACCEPT,
                           margin: int = C.LINK_MARGIN, maybe: int = C.LINK_MAYBE) -> DataFrame:
    """One row per register row that found somebody: the memorial, the scores and whether
    it is a link or a maybe."""
    # each step is written, so that the driver plans and compiles one at a time
    prof = written(profiles(register, "r", "key"), "register-profiles")
    pairs = candidates(prof, written(profiles(memorial, "m", "mid"), "memorial-profiles"), maybe)
    # a profile's first row names it within its cemetery: a short key for the heavy step
    best = written(best_two(pairs, ["cem_id", "r_ord"], "m_mid", "m_n", F.col("tier"), "m_ord"), "best-pairs")
    best = best.withColumn("status", F.when((F.col("score") >= accept) & (F.col("score") - F.col("second") >= margin), "link").otherwise("maybe"))
    decided = prof.select(*_profile_key("r"), "r_ord").join(best, ["cem_id", "r_ord"])
    rows = register.select("cem_id", "ord", "key", *NAME_COLS, *PLOT_COLS)
    return rows_of_profiles(rows, decided, "r").select(
        "cem_id", "ord", "key", F.col("m_mid").alias("mid"), "score", "second", "status")


def best_register_per_memorial(links: DataFrame) -> DataFrame:
    """Reverse link: the highest-scoring register row of each memorial, first row on ties."""
    return links.filter("status = 'link'").groupBy("cem_id", "mid").agg(
        F.max_by("key", F.struct("score", -F.col("ord"))).alias("key"),
        F.max("score").alias("score"),
    )


def era_gated_link(register: DataFrame, memorial: DataFrame, links: DataFrame, cemetery: DataFrame) -> DataFrame:
    """Dateless register rows claim the one memorial of the same full name that died within
    the register's era and is still free; rows claim in register order.

    All open rows of one (surname, canonical first name) see the same memorials, so most of
    the sequence folds into counts: two memorials nobody else can claim close a name for
    good, and a name with one memorial of its own goes to its first row. Only names that
    share memorials through a maiden name go through ordered claims.
    """
    era = cemetery.filter("register_as_of IS NOT NULL").select("cem_id", "register_as_of")
    linked = links.filter("status = 'link'")
    # open rows and offers are read many times below: each is written once, so that no later plan holds theirs
    rows = written(register.join(era, "cem_id").filter("by = 0 AND dy = 0 AND cf <> ''")
                   .join(linked.select("cem_id", "key"), ["cem_id", "key"], "left_anti")
                   .select("cem_id", "key", "ord", "nl", "cf"), "era-rows")
    names = rows.groupBy("cem_id", "nl", "cf").agg(F.min("ord").alias("first_ord"), F.min_by("key", "ord").alias("first_key"))
    free = memorial.join(era, "cem_id") \
        .filter((F.col("dy") != 0) & (F.col("dy") <= F.col("register_as_of")) & (F.col("cf") != "")) \
        .join(linked.select("cem_id", "mid").distinct(), ["cem_id", "mid"], "left_anti") \
        .withColumn("nl", F.explode(F.array_distinct(F.filter(
            F.array("nl", F.nullif(F.col("nm"), F.lit(""))), lambda x: x.isNotNull())))) \
        .select("cem_id", "mid", "nl", "cf").join(names, ["cem_id", "nl", "cf"])
    free = written(free, "era-offers")
    shared = free.groupBy("cem_id", "mid").agg(F.count("*").alias("n_names"))
    offer = free.join(shared, ["cem_id", "mid"])
    own = offer.groupBy("cem_id", "nl", "cf").agg(
        F.count_if(F.col("n_names") == 1).alias("n_own"), F.count("*").alias("n_offer"),
        F.min("mid").alias("mid"), F.min("first_ord").alias("ord"), F.min("first_key").alias("key"))
    simple = own.filter("n_offer = 1 AND n_own = 1").select("cem_id", "key", "mid")
    tangled = own.filter("n_own < 2 AND n_offer > n_own").select("cem_id", "nl", "cf")
    named = lambda df, *cols: df.join(tangled, ["cem_id", "nl", "cf"]).select("cem_id", F.concat_ws("\u001f", "nl", "cf").alias("name"), *cols)
    return simple.unionByName(claims_of_names(named(rows, "key", "ord"), named(offer, "mid"))).withColumn("score", F.lit(C.ERA_SCORE))


def claim_in_order(cand: DataFrame) -> DataFrame:
    """(cem_id, key, ord, mid) -> claims, as if rows came one by one in ``ord``: a row claims
    when exactly one of its candidates is still free, else it is closed for good."""
    own = cand.withColumn("name", F.col("key").cast("string"))
    return claims_of_names(own.select("cem_id", "name", "key", "ord").distinct(), own.select("cem_id", "name", "mid"))


def claims_of_names(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """Ordered claims on a graph of names. ``rows``: cem_id, name, key, ord; ``offers``: cem_id, name, mid, the
    memorials that any row of a name may claim.

    A row claims only what is the last free memorial of its name, so a name claims once at most, by its first
    row after the others' last claim of one of its memorials; all its other rows change nothing and
    are passed over together. A pending claim is carried out when no name that shares the memorial can come
    before it: a rival that has one memorial left by its own pending row, any other by its first row after
    the soonest pending claim of their component. The soonest claim always is, so rounds end, and they
    follow the claims in a component, not the rows of a name."""
    on = ["cem_id", "name"]
    rows, offers = written(rows, "claim-rows"), checkpointed(offers)
    least = offers.groupBy("cem_id", "mid").agg(F.min("name").alias("b"))
    link = offers.join(least, ["cem_id", "mid"]).filter("name <> b").select("cem_id", F.col("name").alias("a"), "b").distinct()
    edges = checkpointed(link.unionByName(link.select("cem_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    comp = connected(offers.select("cem_id", F.col("name").alias("id")).distinct(), edges, "cem_id").select("cem_id", F.col("id").alias("name"), "comp")
    names = checkpointed(offers.groupBy(*on).agg(F.count("*").alias("n_free")).join(comp, on).withColumn("since", F.lit(None).cast(rows.schema["ord"].dataType)))
    first_after = lambda who, t: rows.join(who, on).filter(F.col(t).isNull() | (F.col("ord") > F.col(t))).groupBy(*on).agg(F.min(F.struct("ord", "key")).alias("at"))
    claims = None
    while True:
        one = names.filter("n_free = 1")
        pending = checkpointed(first_after(one.select(*on, "since"), "since").join(names.select(*on, "comp"), on))
        won = checkpointed(_undisputed(pending, names, offers, first_after).select(*on, F.col("at.key").alias("key"), F.col("at.ord").alias("ord"), "mid"))
        claims = won if claims is None else claims.unionByName(won)
        if won.isEmpty():
            return claims.select("cem_id", "key", "mid")
        hit = offers.join(won.select("cem_id", "mid", "ord"), ["cem_id", "mid"]).groupBy(*on).agg(F.count("*").alias("_n"), F.max("ord").alias("_last"))
        # names that have no row left for their last memorial are done
        able = names.filter("n_free > 1").unionByName(one.join(pending.select(*on), on, "left_semi"))
        left = able.join(hit, on, "left").select(*on, (F.col("n_free") - F.coalesce("_n", F.lit(0))).alias("n_free"), "comp", F.coalesce("_last", "since").alias("since"))
        names = checkpointed(left.filter("n_free > 0"))
        offers = checkpointed(offers.join(won.select("cem_id", "mid"), ["cem_id", "mid"], "left_anti").join(names.select(*on), on, "left_semi"))


def _undisputed(pending: DataFrame, names: DataFrame, offers: DataFrame, first_after) -> DataFrame:
    """Pending claims, with their memorial, that no rival can come before."""
    on = ["cem_id", "name"]
    ready = pending.join(offers, on)
    rivals = offers.join(ready.select("cem_id", "mid", "at", F.col("name").alias("claimant")), ["cem_id", "mid"]).filter("name <> claimant")
    soonest = pending.groupBy("cem_id", "comp").agg(F.min("at.ord").alias("soonest"))
    many = names.filter("n_free > 1").join(rivals.select(*on).distinct(), on, "left_semi").join(soonest, ["cem_id", "comp"]).select(*on, "soonest")
    could = pending.select(*on, F.col("at").alias("other")).unionByName(first_after(many, "soonest").withColumnRenamed("at", "other"))
    disputed = rivals.join(could, on).filter(F.col("other") < F.col("at")).select("cem_id", F.col("claimant").alias("name")).distinct()
    return ready.join(disputed, on, "left_anti")


def request_memorial(request: DataFrame, memorial: DataFrame) -> DataFrame:
    mem = memorial.select("cem_id", "mid", F.col("name").alias("mem_name"), F.col("lat").alias("mem_lat"),
                          F.col("lng").alias("mem_lng"), F.col("flags").alias("mem_flags"), F.lit(True).alias("has_memorial"))
    return request.join(mem, ["cem_id", "mid"], "left").withColumn("has_memorial", F.coalesce("has_memorial", F.lit(False)))


def request_register_fuzzy(request: DataFrame, register: DataFrame) -> DataFrame:
    """Best register row by name and years alone (plots never count here): 70 is enough, 58
    with exact names and no year apart by more than three."""
    q, g = written(profiles(request, "q", "mid", False), "request-profiles"), written(profiles(register, "g", "key", False), "register-profiles")
    pairs = scored_profiles(q, g, "q", "g",
                            C.REQUEST_RELAXED, with_plot=False, initials=False, meets=("sound",)).filter("q_sx = g_sx")
    close = lambda c: (F.col(f"q_{c}") == 0) | (F.col(f"g_{c}") == 0) | (F.abs(F.col(f"q_{c}") - F.col(f"g_{c}")) <= 3)
    exact = (F.col("g_nl") == F.col("q_nl")) & (F.col("q_fr") != "") & \
        ((F.col("g_cf") == F.col("q_cf")) | (F.col("g_fr") == F.col("q_fr")))
    on = ["cem_id"] + [f"q_{c}" for c in NAME_COLS]
    best = pairs.groupBy(*on).agg(F.max_by(
        F.struct(F.col("g_key").alias("key"), "score", (exact & close("by") & close("dy")).alias("sure")),
        F.struct("score", -F.col("g_ord"))).alias("b")).select(*on, "b.*")
    best = best.filter((F.col("score") >= C.REQUEST_ACCEPT) | F.col("sure")).drop("sure")
    return rows_of_profiles(request.select("cem_id", "ord", "mid", *NAME_COLS), best, "q", False) \
        .select("cem_id", "ord", "mid", "key", "score")


def request_register_unique(request: DataFrame, register: DataFrame, links: DataFrame) -> DataFrame:
    """The only unlinked register row whose name allows for one slip and whose years agree
    (or, with no years to compare, whose names agree exactly)."""
    loose = register.join(links.filter("status = 'link'").select("cem_id", "key"), ["cem_id", "key"], "left_anti")
    q = profiles(request.filter("nl <> '' AND cf <> ''"), "q", "mid", False)
    g = profiles(loose, "g", "key", False)
    # years that agree, or none to compare: what meets by first name alone has years that don't clash
    kinds = _kinds(False, initials=False, meets=("sound",))
    pairs = _keyed(q, "q", 1, True, False, kinds).join(_keyed(g, "g", 2, False, False, kinds).hint("merge"), ["cem_id", "kind", "bkey"])
    pairs = pairs.filter(F.col("kind") == _first_meeting("q", "g", kinds))
    same = lambda c: F.col(f"q_{c}") == F.col(f"g_{c}")
    last = same("nl") | (F.levenshtein("q_nl", "g_nl", 2) >= 0)
    first_exact = same("cf")
    first = first_exact | ((F.col("g_fr") != "") & (F.col("q_fr") != "") & (same("fr") | (F.levenshtein("q_fr", "g_fr", 2) >= 0)))
    both = lambda c: (F.col(f"q_{c}") != 0) & (F.col(f"g_{c}") != 0)
    gap = lambda c: F.abs(F.col(f"q_{c}") - F.col(f"g_{c}"))
    clash = (both("by") & (gap("by") > 1)) | (both("dy") & (gap("dy") > 1))
    sure = both("by") | both("dy") | (same("nl") & first_exact)
    on = ["cem_id"] + [f"q_{c}" for c in NAME_COLS]
    one = pairs.filter(last & first & ~clash & sure).groupBy(*on) \
        .agg(F.sum("g_n").alias("n"), F.min("g_key").alias("key")).filter("n = 1").drop("n")
    return rows_of_profiles(request.select("cem_id", "ord", "mid", *NAME_COLS), one, "q", False) \
        .select("cem_id", "ord", "mid", "key", F.lit(C.UNIQUE_SCORE).alias("score"))


def request_links(request: DataFrame, register: DataFrame, memorial_register: DataFrame, links: DataFrame) -> DataFrame:
    """The register row of every request: through its memorial, else fuzzy, else unique."""
    # each way is written: the next one starts from what it left
    via = written(request.join(memorial_register.select("cem_id", "mid", "key", "score"), ["cem_id", "mid"])
                  .select("cem_id", "ord", "mid", "key", "score", F.lit("memorial").alias("how")), "links-by-memorial")
    left = request.join(via.select("cem_id", "ord"), ["cem_id", "ord"], "left_anti")
    fuzzy = written(request_register_fuzzy(left, register).withColumn("how", F.lit("fuzzy")), "links-by-score")
    rest = left.join(fuzzy.select("cem_id", "ord"), ["cem_id", "ord"], "left_anti")
    unique = request_register_unique(rest, register, links).withColumn("how", F.lit("unique"))
    return union_all([via, fuzzy, unique])


def cross_cemetery_matches(request: DataFrame, memorial: DataFrame, register: DataFrame, links: DataFrame, cap: int = 3) -> DataFrame:
    """The same person at another cemetery: names equal, years within one and none apart.
    The first ``cap`` hits per request, in cemetery order, memorials before register rows.

    Leaving out one cemetery can remove at most ``cap + 1`` of its rows, so twice as many
    rows per (name, years) are enough on the searched side, whatever a name's frequency."""
    mem = memorial.filter("nl <> '' AND cf <> ''").select("cem_id", "ord", F.col("mid").alias("id"), "nl", "cf", "by", "dy", F.lit(0).alias("kind"))
    ros = register.filter("nl <> '' AND cf <> '' AND dy <> 0") \
        .join(links.filter("status = 'link'").select("cem_id", "key"), ["cem_id", "key"], "left_anti") \
        .select("cem_id", "ord", F.col("key").alias("id"), "nl", "cf", F.lit(0).alias("by"), "dy", F.lit(1).alias("kind"))
    person = ["nl", "cf", "by", "dy", "kind"]
    found = mem.unionByName(ros)
    found = found.withColumn("_i", F.row_number().over(Window.partitionBy(*person, "cem_id").orderBy("ord"))).filter(F.col("_i") <= cap + 1)
    found = found.withColumn("_j", F.row_number().over(Window.partitionBy(*person).orderBy("cem_id", "ord"))).filter(F.col("_j") <= 2 * cap + 2)
    # written, so that ranking persons and meeting requests are planned one at a time
    found = written(found.select(*[F.col(c).alias(f"f_{c}") for c in ["cem_id", "ord", "id", *person]]), "persons")
    year = lambda tag, y, spread: F.when(y != 0, F.transform(F.array(*[y + d for d in spread]), lambda v: F.concat(F.lit(tag), v.cast("string")))) \
        .otherwise(F.array().cast("array<string>"))
    req = request.filter("nl <> '' AND cf <> '' AND (by <> 0 OR dy <> 0)").select("cem_id", "ord", "mid", "nl", "cf", "by", "dy") \
        .withColumn("yk", F.explode(F.concat(year("d", F.col("dy"), (-1, 0, 1)), year("b", F.col("by"), (-1, 0, 1)))))
    found = found.withColumn("yk", F.explode(F.concat(year("d", F.col("f_dy"), (0,)), year("b", F.col("f_by"), (0,)))))
    both = lambda c: (F.col(c) != 0) & (F.col(f"f_{c}") != 0)
    gap = lambda c: F.abs(F.col(c) - F.col(f"f_{c}"))
    j = req.join(found, (req.yk == found.yk) & (req.nl == found.f_nl) & (req.cf == found.f_cf) & (req.cem_id != found.f_cem_id)) \
        .filter(~(both("by") & (gap("by") > 1)) & ~(both("dy") & (gap("dy") > 1))) \
        .filter((F.col("mid") != F.col("f_id")) | (F.col("f_kind") == 1)) \
        .filter(F.left(req.yk, F.lit(1)) == F.when(both("dy"), "d").otherwise("b"))
    w = Window.partitionBy("cem_id", "ord").orderBy("f_cem_id", "f_kind", "f_ord")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select(
        "cem_id", "mid", F.col("f_cem_id").alias("other_cem"), F.when(F.col("f_kind") == 0, "mem").otherwise("ros").alias("kind"),
        F.col("f_id").alias("id"), "rank")


def unlinked_burials(register: DataFrame, memorial: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.filter("status = 'link'")
    ros = register.join(linked.select("cem_id", "key"), ["cem_id", "key"], "left_anti").select("cem_id", F.lit("ros").alias("kind"), F.col("key").alias("id"))
    mem = memorial.join(linked.select("cem_id", "mid"), ["cem_id", "mid"], "left_anti").select("cem_id", F.lit("mem").alias("kind"), F.col("mid").alias("id"))
    return ros.unionByName(mem)
