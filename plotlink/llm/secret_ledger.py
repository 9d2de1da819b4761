"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every version of every path is content-addressed (SHA-256 of its text). Only pairs of blob and
rule version that the ledger lacks are scanned; findings are kept per blob and joined back to all
paths. Rules are data: kind, version, pattern, the group whose length counts and the least length.

Defined cases: a null text is empty; an empty text is scanned and has no span; repeated rows share a
blob, are scanned once and each get its findings; an empty table gives an empty ledger."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotlink.llm.common import new_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is under ``least``
    characters are dropped. ``hint``: lower-case text without which there is no match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str = ""


#: In the order in which spans that start together are listed. A run that is long enough is matched whole.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="akia"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", hint="private key"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyj"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}", hint="gh"),
)


#: Matches that are placed one after the other.
PIECE = 64


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind order, kind, end), code points, end exclusive. What lies between the
    matches and the matches themselves alternate, so their lengths give the positions."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x))
    long_enough = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.char_length(x) >= rule.least)
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("len"), long_enough.alias("ok"))
    # appending copies an array, so matches are placed in pieces, whose starts are summed first
    pieces = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / PIECE).cast("int")), lambda i: F.slice(e, i * PIECE + 1, F.lit(PIECE)))
    width = lambda piece: F.aggregate(piece, F.lit(0), lambda at, x: at + x["gap"] + x["len"])
    starts = lambda ps: F.aggregate(F.transform(ps, width), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                         lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["len"]).alias("at"),
        F.when(x["ok"], F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + x["gap"]).alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (acc["at"] + x["gap"] + x["len"]).alias("end")))))
        .otherwise(acc["out"]).alias("out"))
    placed = lambda piece, at: F.aggregate(piece, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    spans = bound(each, lambda e: bound(pieces(e), lambda ps: F.flatten(F.zip_with(ps, starts(ps), placed))))
    any_match = F.rlike(text, pattern)
    return F.when(F.lower(text).contains(rule.hint) & any_match if rule.hint else any_match, spans).otherwise(empty)


def versioned(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the pairs that ``ledger`` lacks. A row says
    that the blob was scanned by that rule, also where nothing was found."""
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>"))))
    todo = todo.filter(F.size("todo") > 0)
    one = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                             F.when(F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), spans_of(F.col("text"), r, i)).alias("spans"))
                    for i, r in enumerate(rules)])
    return todo.select("blob", F.inline(one)).filter(F.col("spans").isNotNull())


def extended(versions: DataFrame, path: str | None, rules=RULES) -> str:
    """Scans what the ledger at ``path`` lacks and appends it; gives the ledger's path."""
    spark = versions.sparkSession
    old = spark.read.parquet(path) if path else None
    path = path or new_path(spark, "ledger")
    scan(versions, old, rules).write.mode("append").parquet(path)
    return path


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """path and all spans of its blob by the given rules, ordered by start, then rule. What two runs at once
    wrote twice into the ledger counts once."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    of = ledger.filter(F.array_contains(current, F.struct("kind", "version")) & (F.size("spans") > 0)).groupBy("blob").agg(F.collect_set(F.struct("kind", "version", "spans")).alias("scans")) \
        .select("blob", F.sort_array(F.flatten(F.col("scans.spans"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return versions.select("path", "blob").join(of, "blob", "left").select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


BASE_KINDS = ("assign", "access", "hex")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "blob")
