"""Name expressions: split, normalise, first-name token, sound code."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions.frames import once


def norm_name(c: Column) -> Column:
    """Lower-case letters only; quotes and dots vanish, titles and the rest become spaces."""
    s = F.lower(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, C.NAME_PUNCT, "")
    s = F.regexp_replace(s, C.NAME_TITLES, " ")
    return F.trim(F.regexp_replace(s, "[^a-z]+", " "))


def first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def soundex_key(norm: Column) -> Column:
    return F.soundex(F.regexp_replace(norm, " ", ""))


def _tidy(full: Column) -> Column:
    s = F.regexp_replace(F.coalesce(full, F.lit("")), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def last_first(full: Column) -> tuple[Column, Column]:
    """(surname, given names) from "Last, First" or "First Middle Last" text."""
    s = _tidy(full)
    comma = r"^([^,]+),\s*(.*)$"
    has = s.rlike(comma)
    before = F.trim(F.regexp_extract(s, comma, 1))
    plain = F.regexp_replace(s, C.NAME_SUFFIX_TAIL, "")
    last = F.when(has, F.regexp_replace(before, C.NAME_SUFFIX_TAIL, "")).otherwise(
        F.regexp_extract(plain, r"(\S+)$", 1)
    )
    first = F.when(has, F.trim(F.regexp_extract(s, comma, 2))).otherwise(
        F.trim(F.regexp_replace(plain, r"\S+$", ""))
    )
    return last, first


def nickname_table(spark: SparkSession) -> DataFrame:
    """Two columns, one row per nickname of the fixed table (189 rows, safe to broadcast)."""
    rows = ",".join(
        f"('{nick}','{canon}')" for nick, canon in C.NICKNAMES.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(nick, canon)")


def canonical_first(df: DataFrame, token_col: str, out: str) -> DataFrame:
    nick = nickname_table(df.sparkSession).select(
        F.col("nick").alias("_nick"), F.col("canon").alias("_canon")
    )
    return (
        df.join(F.broadcast(nick), F.col(token_col) == F.col("_nick"), "left")
        .withColumn(out, F.coalesce("_canon", token_col))
        .drop("_nick", "_canon")
    )


def name_keys(df: DataFrame, name_col: str, alt_col: str | None = None) -> DataFrame:
    """Adds last, first and the link keys nl, sx, nm, cf, fr, sk."""
    last, first = last_first(F.col(name_col))
    alt = norm_name(F.col(alt_col)) if alt_col else F.lit("")
    no_alt = F.coalesce(F.col(alt_col), F.lit("")) == "" if alt_col else F.lit(True)
    df = once(df, {"last": last, "first": first, "nm": alt, "_full": norm_name(F.col(name_col))})
    df = once(df, {
        "nl": norm_name(F.col("last")),
        "fr": first_token(norm_name(F.col("first"))),
        "sk": F.when(no_alt, F.col("_full")).otherwise(F.concat_ws(" ", "_full", "nm")),
    }).drop("_full")
    df = df.withColumn("sx", soundex_key(F.col("nl")))
    return canonical_first(df, "fr", "cf")


def former_surname(c: Column) -> Column:
    """Normalised surname of a register's former-name text."""
    last, _ = last_first(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(
        norm_name(F.coalesce(F.nullif(last, F.lit("")), c))
    )
