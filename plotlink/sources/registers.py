"""Register pages and transcripts: HTML records, position codes, walk-order books."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions import plots
from plotlink.functions.frames import once

LABEL_VALUE = r'label-value-row-label">([^<]*)</div><div role="cell" class="label-value-row-value">([^<]*)<'


def _decode(c: Column) -> Column:
    c = F.regexp_replace(c, "&nbsp;?", " ")
    return F.trim(F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'")))


def extract_label_values(pages: DataFrame, id_col: str, html_col: str, pair_regex: str = LABEL_VALUE, keep=tuple(C.REGISTER_LABELS)) -> DataFrame:
    """First value per label of each page. Entities are decoded, a value that only repeats
    its label is empty. ``keep``: the labels that count, those of register pages unless others are given; None keeps
    all."""
    pair = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pair_regex), F.lit(1)).alias("label"),
                        F.regexp_extract_all(html_col, F.lit(pair_regex), F.lit(2)).alias("value"))
    df = pages.select(id_col, F.posexplode(pair).alias("pos", "p"))
    df = df.select(id_col, "pos", F.trim(F.col("p.label")).alias("label"), _decode(F.col("p.value")).alias("value")).filter("label <> ''")
    if keep is not None:
        df = df.filter(F.col("label").isin(*keep))
    df = df.withColumn("value", F.when(F.col("value") == F.col("label"), "").otherwise(F.col("value")))
    return df.groupBy(id_col, "label").agg(F.min_by("value", "pos").alias("value"))


RECORD_ENTRY = r'(?s)<div class="record-entry">.*?</div>'


def extract_record_entries(pages: DataFrame, id_col: str, html_col: str, block_regex: str = RECORD_ENTRY, name_regex: str = r"^(.*?),\s*(.*?):\s*(.*)$") -> DataFrame:
    """One row per entry block: name parts, dates, veteran flag and parsed plot."""
    df = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(block_regex), F.lit(0))).alias("pos", "b"))
    df = once(df, {"_t": F.trim(F.regexp_replace(F.regexp_replace("b", "<[^>]+>", ""), r"\s+", " "))}).drop("b").filter(F.col("_t").rlike(name_regex))
    part = lambda i: F.regexp_extract("_t", name_regex, i)
    df = once(df, {"last": F.upper(part(1)), "first": F.upper(part(2)), "_r": part(3)})
    x = lambda p: F.regexp_extract("_r", p, 1)
    df = once(df, {"bd": x(r"\bb\.\s*([\d/]+)"), "dd": x(r"\bd\.\s*([\d/]+)"), "burial": x(r"\bbur\.\s*([\d/]+)"),
                   "flags": F.when(F.col("_r").rlike(r"(?i)\bVeteran\b"), 4).otherwise(0), "_p": x(r"Plot:\s*(.+)$")}).drop("_t", "_r")
    return plots.parse_generic(df, "_p").drop("_p")


def flatten_register_records(records: DataFrame, coded: bool) -> DataFrame:
    """Cached register records to register rows. ``coded``: section codes go through the
    code table, otherwise bare numbers become "Section N"."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    df = records.filter(~F.coalesce("miss", F.lit(False)) & (F.coalesce("name", F.lit("")) != "")).withColumn("_s", t("section"))
    if coded:
        # here only the padded forms of the table count
        codes = plots.section_code_table(df.sparkSession).withColumn("_bare", F.lpad("_bare", 2, "0"))
        df = df.join(F.broadcast(codes), F.col("_s") == F.col("_bare"), "left")
        section, sub = F.coalesce("code_section", "_s"), F.coalesce("code_sub", F.lit(""))
    else:
        bare = F.regexp_replace("_s", "^0+", "")
        section, sub = F.when(F.col("_s").rlike("^[0-9]+$") & (bare != ""), F.concat(F.lit("Section "), bare)).otherwise(F.col("_s")), F.lit("")
    labelled = lambda c, label: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    note = F.concat_ws(" | ", some("user3"), some("notes"), labelled("head", "head: "), labelled("foot", "foot: "), labelled("funeral_home", "funeral home: "))
    return df.select(
        "cem_id", "key", t("name").alias("name"), t("sex").alias("sex"), t("bd").alias("bd"), t("dd").alias("dd"), t("burial").alias("burial"),
        section.alias("section"), sub.alias("sub"), F.regexp_replace(F.upper(t("block")), r"^(?:BLOCK|BLCK|BLK)\s*", "").alias("block"),
        plots.strip_zeros(t("lot")).alias("lot"), plots.strip_zeros(t("plot")).alias("grave"), t("status").alias("status"),
        F.when(F.lower(t("veteran")).startswith("y"), 4).otherwise(0).alias("flags"),
        F.substring(F.trim(F.regexp_replace(note, r"\s+", " ")), 1, 160).alias("note"), t("former").alias("former"))


def _filled(template: str, src: Column, pattern: str) -> Column:
    """A grammar part: literal text with $n (integer), ^n (upper, zeros stripped), ~n (as is)."""
    if len(template) < 2 or template[-2] not in "$^~":
        return F.lit(template)
    head, how, n = template[:-2], template[-2], int(template[-1])
    g = F.regexp_extract(src, pattern, n)
    val = {"$": F.coalesce(g.try_cast("bigint").cast("string"), F.lit("")), "^": plots.norm_block(g), "~": g}[how]
    return F.concat(F.lit(head), val)


def decode_position_codes(rows: DataFrame, grammars=None) -> DataFrame:
    """Position text to plot parts by the cemetery's own grammars, first match in order.
    ``rows`` carry grammar (the cemetery's name), plot and mapno."""
    grammars = grammars or C.POSITION_GRAMMARS
    src = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("plot", "mapno")}
    tries = [(F.col("grammar") == cem) & src[field].rlike(p) for cem, field, p, *_ in grammars]
    out = {}
    for i, part in enumerate(("section", "block", "lot", "grave")):
        out[part] = F.coalesce(*[F.when(hit, _filled(g[3 + i], src[g[1]], g[2])) for hit, g in zip(tries, grammars)])
    return once(rows, out)


def position_share(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("grammar").agg(F.count("*").alias("n"), F.count_if(F.col("section").isNotNull()).alias("n_located"),
                                          F.floor(100 * F.count_if(F.col("section").isNotNull()) / F.count("*") + 0.5).cast("int").alias("located_pct"))


CHUNK = 65536


def running(df: DataFrame, by: str, line: str, last: dict[str, Column], count: dict[str, Column]) -> DataFrame:
    """Running "last non-null so far" and running counts along each file's lines.

    A file is cut into chunks of lines. Chunks are summarised, the few summaries run in
    order, and each chunk then runs on its own from what came before it, so one very long
    file is spread like many short ones."""
    df = df.withColumn("_c", F.floor(F.col(line) / CHUNK))
    stamp = {k: F.when(v.isNotNull(), F.struct(F.col(line).alias("at"), v.alias("v"))) for k, v in last.items()}
    df = df.withColumns({f"_l_{k}": v for k, v in stamp.items()} | {f"_n_{k}": F.when(v, 1).otherwise(0) for k, v in count.items()})
    per = df.groupBy(by, "_c").agg(*[F.max(f"_l_{k}").alias(f"_pl_{k}") for k in last], *[F.sum(f"_n_{k}").alias(f"_pn_{k}") for k in count])
    prev = Window.partitionBy(by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(by, "_c", *[F.max(f"_pl_{k}").over(prev).alias(f"_bl_{k}") for k in last],
                     *[F.coalesce(F.sum(f"_pn_{k}").over(prev), F.lit(0)).alias(f"_bn_{k}") for k in count])
    here = Window.partitionBy(by, "_c").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(per, [by, "_c"])
    made = {k: F.greatest(F.max(f"_l_{k}").over(here), F.col(f"_bl_{k}")) for k in last} | {
        k: F.sum(f"_n_{k}").over(here) + F.col(f"_bn_{k}") for k in count}
    df = df.withColumns({f"_out_{k}": v for k, v in made.items()})
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, *[F.col(f"_out_{k}").alias(k) for k in made])


NOT_A_BURIAL = r"(?i)©|copyright|return to|migenweb|transcribed"


def walk_order_transcript(lines: DataFrame) -> DataFrame:
    """A walk-order book (file, line, text): SECTION and Row headers carry forward, and every
    name line between them is the next position of its row."""
    word = lambda p: F.lower(F.regexp_extract("text", p, 1))
    words = F.array(*[F.lit(w) for w in C.NUMBER_WORDS])
    num = lambda p: F.nullif(F.array_position(words, word(p)).cast("int"), F.lit(0))
    df = once(lines, {"_sec": num(r"(?i)^SECTION\s+(\w+)"), "_row": num(r"(?i)^Row\s+(\w+)"),
                      "is_name": F.col("text").rlike(r"^[A-Z][A-Za-z' .()-]*?,\s*.+$") & ~F.col("text").rlike(NOT_A_BURIAL)})
    df = df.withColumn("is_name", F.col("is_name") & F.col("_sec").isNull() & F.col("_row").isNull()).withColumnsRenamed({"_sec": "sec", "_row": "row"})
    # a section header clears the row: a row counts only if it came after it
    head = running(df, "file", "line", {"s": F.col("sec"), "r": F.col("row")}, {})
    ok = F.col("is_name") & F.col("s").isNotNull() & F.col("r").isNotNull() & (F.col("r.at") > F.col("s.at"))
    # positions: names counted so far minus names counted up to the row's header
    cnt = running(head.withColumn("counts", ok), "file", "line", {}, {"cum": F.coalesce(ok, F.lit(False))})
    cnt = cnt.withColumn("here", F.when(F.col("row").isNotNull(), F.col("cum")))
    fin = running(cnt, "file", "line", {"base": F.col("here")}, {}).filter("counts")
    rest = F.regexp_extract("text", r"^[A-Z][A-Za-z' .()-]*?,\s*(.+)$", 1)
    year = r"\b(?:1[6-9]|20)\d\d\b"
    fin = once(fin, {"_rest": rest, "last": F.upper(F.regexp_extract("text", r"^([A-Z][A-Za-z' .()-]*?),\s*.+$", 1)),
                     "_ys": F.regexp_extract_all(rest, F.lit(f"({year})"), F.lit(1))})
    n = F.size("_ys")
    given = F.when(n > 0, F.regexp_extract("_rest", rf"^(.*?){year}", 1)).otherwise(F.col("_rest"))
    note = F.when(n > 0, F.regexp_extract("_rest", rf"^.*{year}(.*)$", 1)).otherwise("")
    return fin.select(
        "file", "line", F.concat("last", F.lit(", "), F.upper(F.trim(F.regexp_replace(given, r"[-–\s]+$", "")))).alias("name"),
        F.when(n >= 2, F.get("_ys", F.lit(0))).otherwise("").alias("bd"), F.when(n >= 1, F.element_at("_ys", -1)).otherwise("").alias("dd"),
        F.concat(F.lit("Section "), F.col("s.v").cast("string")).alias("section"), F.col("r.v").cast("string").alias("block"),
        (F.col("cum") - F.coalesce("base.v", F.lit(0))).cast("string").alias("lot"),
        F.substring(F.regexp_replace(F.regexp_replace(note, r"^[()\s-]+", ""), r"[()\s]+$", ""), 1, 120).alias("note"))


def triplet_transcript(lines: DataFrame, as_of: int = 1941) -> DataFrame:
    """A sexton's book (file, line, text) of name, row and lot lines. A name line opens a
    record; the first single letter is its row, the first number after that its lot, other
    lines are its note; everything from the footer on is dropped."""
    stop = F.col("text").rlike(r"(?i)©|copyright|return to|isabella county")
    is_name = F.col("text").rlike(r"^[A-Z][A-Za-z' .-]*,") | F.col("text").rlike(r"^[A-Z][A-Z' -]{2,}$")
    end = lines.filter(stop).groupBy("file").agg(F.min("line").alias("_end"))
    df = lines.join(end, "file", "left").filter(F.col("_end").isNull() | (F.col("line") < F.col("_end"))).drop("_end")
    df = running(df.withColumn("is_name", is_name), "file", "line", {}, {"rec": F.col("is_name")}).filter("rec > 0")
    by = ["file", "rec"]
    row_at = df.filter(~F.col("is_name") & F.col("text").rlike("(?i)^[A-Z]$")).groupBy(*by).agg(F.min("line").alias("row_at"))
    df = df.join(row_at, by, "left")
    lot_at = df.filter((F.col("line") > F.col("row_at")) & F.col("text").rlike("^[0-9][0-9A-Za-z/ .]*$")).groupBy(*by).agg(F.min("line").alias("lot_at"))
    df = df.join(lot_at, by, "left")
    is_row, is_lot = F.col("line") == F.col("row_at"), F.col("line") == F.col("lot_at")
    note_line = ~F.col("is_name") & ~F.coalesce(is_row, F.lit(False)) & ~F.coalesce(is_lot, F.lit(False))
    # a note is cut at 120 characters, so the first lines that fill it are all it can use
    w = Window.partitionBy(*by).orderBy("line")
    notes = df.filter(note_line).withColumn("_i", F.row_number().over(w)).filter("_i <= 120").groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("note"))
    out = df.groupBy(*by).agg(
        F.max(F.when(F.col("is_name"), F.upper("text"))).alias("name"), F.max(F.when(is_row, F.upper("text"))).alias("block"),
        F.max(F.when(is_lot, F.regexp_replace("text", "[^0-9]", ""))).alias("lot")).join(notes, by, "left")
    e = F.lit("")
    return out.select(*by, "name", F.lit("*").alias("section"), F.coalesce("block", e).alias("block"), F.coalesce("lot", e).alias("lot"),
                      F.substring(F.concat(F.lit(f"sexton record {as_of}"), F.coalesce(F.concat(F.lit(" · "), "note"), e)), 1, 120).alias("note"))
