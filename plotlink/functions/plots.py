"""Plot text, plot codes and plot keys as column expressions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions.frames import once

PARTS = ["section", "sub", "block", "lot", "grave"]


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"^0+(\d)", "$1")


def norm_block(c: Column) -> Column:
    return strip_zeros(F.upper(F.coalesce(c, F.lit(""))))


def int_prefix(c: Column) -> Column:
    """Leading integer of a text, null when it does not start with one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def canonical_lot(c: Column) -> Column:
    return F.coalesce(int_prefix(c).cast("string"), c)


def lot_key(c: Column) -> Column:
    """Anchor key of a lot: a non-zero leading integer, else the text itself."""
    n = int_prefix(c)
    return F.when(n != 0, n.cast("string")).otherwise(F.coalesce(c, F.lit("")))


def plot_group(section: Column, sub: Column, block: Column) -> tuple[Column, Column]:
    """(sub, block) parts of the plot key: lots-only sections are keyed by sub alone."""
    lots_only = section.isin(*C.LOTS_ONLY_SECTIONS)
    return (
        F.when(lots_only, F.coalesce(sub, F.lit(""))).otherwise(F.lit("")),
        F.when(lots_only, F.lit("")).otherwise(F.coalesce(block, F.lit(""))),
    )


def _clean(c: Column) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[().,]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def parse_generic(df: DataFrame, plot_col: str) -> DataFrame:
    """Adds section, sub, block, lot, grave; section is null for text that names no plot."""
    x = F.regexp_extract
    empty = F.lit("")
    s = F.col("_s")
    df = once(df, {"_s": _clean(F.col(plot_col))})
    df = once(df, {
        "_ok": (s != "") & ~s.rlike(C.PLOT_JUNK),
        "_sub": x(s, C.PLOT_SUB, 1),
        "_blk": norm_block(x(s, C.PLOT_BLOCK, 1)),
        "_lot": x(s, C.PLOT_LOT, 1),
        "_grv": x(s, C.PLOT_GRAVE, 1),
        "_tok": x(s, C.PLOT_TOKEN, 1),
        "_sec": x(s, C.PLOT_SECTION, 1),
        "_lead": x(s, C.PLOT_LEAD, 1),
        "_dash": F.split(s, r"\s*-\s*", -1),
    })
    lead = F.regexp_replace(F.col("_lead"), C.PLOT_RECORD_ID, "")
    lead = F.regexp_replace(lead, C.PLOT_LONG_NUMBER, "")
    lead = F.trim(F.regexp_replace(lead, r"\s+", " "))
    df = once(df, {
        # a "Plot n" token is the grave slot, unless a grave is given: then it is the lot
        "_lot": F.when((F.col("_lot") == "") & (F.col("_grv") != ""), F.col("_tok")).otherwise(F.col("_lot")),
        "_grv": F.when(F.col("_grv") == "", F.col("_tok")).otherwise(F.col("_grv")),
        "_lead": lead,
    })
    df = once(df, {
        "_sec": F.when((F.col("_sec") != "") & ~F.col("_sec").rlike(C.PLOT_SECTION_NOT),
               F.concat(F.lit("Section "), F.upper("_sec")))
        .when((F.length("_lead") > 1) & ~F.col("_lead").rlike(r"^\d+$"), F.col("_lead"))
        .otherwise(empty),
    })
    bare = (F.col("_sec") == "") & (F.col("_blk") == "") & (F.col("_lot") == "") & (F.col("_grv") == "")
    part = lambda i: F.coalesce(F.get("_dash", F.lit(i)), empty)
    third, fourth = norm_block(part(2)), strip_zeros(part(3))
    half = (fourth == "") | fourth.rlike(C.PLOT_HALF_LOT)
    code = F.when(~bare, F.lit("tokens")) \
        .when(F.size("_dash") >= 4, F.when(half, F.lit("dash_half")).otherwise(F.lit("dash"))) \
        .when(s.rlike(C.PLOT_LOT_LETTER), F.lit("lot_letter")) \
        .when(s.rlike("^[A-Za-z]{1,2}$"), F.lit("block")) \
        .when(s.rlike(r"^\d{1,4}$"), F.lit("lot")) \
        .when(s.rlike(C.PLOT_BARE_NAME) & ~s.rlike(C.PLOT_BARE_NAME_NOT), F.lit("name"))
    df = once(df, {"_kind": F.when(F.col("_ok"), code)})
    k = F.col("_kind")
    dashed = k.isin("dash", "dash_half")
    df = once(df, {
        "_sec": F.when(dashed, part(1)).when(k == "name", s).otherwise(F.col("_sec")),
        "_lot": F.when(k == "dash", fourth).when(k == "dash_half", third)
        .when(k == "lot_letter", x(s, C.PLOT_LOT_LETTER, 1)).when(k == "lot", s).otherwise(F.col("_lot")),
        "_blk": F.when(k == "dash", third).when(k == "dash_half", empty)
        .when(k == "block", F.upper(s)).otherwise(F.col("_blk")),
        "_grv": F.when(dashed, part(4))
        .when(k == "lot_letter", F.upper(x(s, C.PLOT_LOT_LETTER, 2))).otherwise(F.col("_grv")),
    })
    located = (F.col("_blk") != "") | (F.col("_lot") != "") | (F.col("_grv") != "")
    section = F.when(k.isNotNull(), F.coalesce(F.nullif(F.col("_sec"), empty), F.when(located, F.lit("*"))))
    have = section.isNotNull()
    return once(df, {
        "section": section,
        "sub": F.when(have, F.col("_sub")),
        "block": F.when(have, F.col("_blk")),
        "lot": F.when(have, canonical_lot(F.col("_lot"))),
        "grave": F.when(have, F.col("_grv")),
    }).drop("_s", "_ok", "_sub", "_blk", "_lot", "_grv", "_tok", "_sec", "_lead", "_dash", "_kind")


def alias_section(c: Column, aliases=None) -> Column:
    """First alias, in table order, whose pattern matches the text."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for p, name in aliases or C.SECTION_ALIASES])


def parse_aliased(df: DataFrame, plot_col: str, aliases=None) -> DataFrame:
    """Plot parts for a cemetery whose section names go through an ordered alias table."""
    s = F.col("_s")
    x = F.regexp_extract
    df = once(df, {"_s": _clean(F.col(plot_col))})
    df = once(df, {
        "section": F.when((s != "") & ~s.rlike(C.PLOT_JUNK), alias_section(s, aliases)),
        "_sub": x(s, C.ALIASED_SUB, 1),
        "_blk": norm_block(x(s, C.ALIASED_BLOCK, 1)),
        "_txt": x(s, C.SUB_FROM_TEXT, 1),
    })
    open_sub = (F.col("section") == C.SUB_FROM_BLOCK_SECTION) & (F.col("_sub") == "")
    moved = open_sub & (F.col("_txt") == "") & F.col("_blk").rlike("^[1-5]$")
    have = F.col("section").isNotNull()
    return once(df, {
        "sub": F.when(have, F.when(moved, F.col("_blk")).when(open_sub, F.col("_txt")).otherwise(F.col("_sub"))),
        "block": F.when(have, F.when(moved, F.lit("")).otherwise(F.col("_blk"))),
        "lot": F.when(have, canonical_lot(x(s, C.ALIASED_LOT, 1))),
        "grave": F.when(have, x(s, C.ALIASED_GRAVE, 1)),
    }).drop("_s", "_sub", "_blk", "_txt")


def section_code_table(spark: SparkSession) -> DataFrame:
    """Code (padding stripped) -> section and sub; 17 rows, safe to broadcast."""
    rows = ",".join(
        f"('{int(code)}','{sec}','{sub}')" for code, (sec, sub) in C.SECTION_CODES.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(_bare, code_section, code_sub)")


def bare_section_code(c: Column) -> Column:
    """The code without the zeros the table forgives, as ``section_code_table`` lists it."""
    return F.regexp_replace(c, r"^(?:0{0,2}([1-9])|0?([1-9]\d))$", "$1$2")


def decode_code(df: DataFrame, code_col: str, code_table: DataFrame | None = None) -> DataFrame:
    """Adds section..grave from CEM-SEC-BLOCK-LOT-GRAVE codes; null section when not a code."""
    codes = section_code_table(df.sparkSession) if code_table is None else code_table
    x = lambda i: F.regexp_extract("_c", C.PLOT_CODE, i)
    df = df.withColumn("_c", F.trim(F.coalesce(F.col(code_col), F.lit(""))))
    ok = F.col("_c").rlike(C.PLOT_CODE)
    df = df.withColumns({
        "_ok": ok,
        "_n": x(2),
        # each code is known bare and padded to two digits, and one further zero is forgiven
        "_key": F.when(
            ok & (F.upper(x(1)) == C.CODED_CEMETERY),
            bare_section_code(x(2)),
        ),
    })
    df = df.join(F.broadcast(codes), F.col("_key") == F.col("_bare"), "left")
    have = F.col("_ok")
    return df.withColumns({
        "section": F.when(have, F.coalesce("code_section", F.concat(F.lit("Section "), strip_zeros(F.col("_n"))))),
        "sub": F.when(have, F.coalesce("code_sub", F.lit(""))),
        "block": F.when(have, norm_block(x(3))),
        "lot": F.when(have, strip_zeros(x(4))),
        "grave": F.when(have, x(5)),
    }).drop("_c", "_ok", "_n", "_key", "_bare", "code_section", "code_sub")
