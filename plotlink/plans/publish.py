"""Published documents and their totals.

A bundle is a folder of lines, each a document of the format that ``read_bundle`` reads. A cemetery's first line
holds its facts: place, contact, dates, sections, maps, grounds, and a manifest of how many rows follow. Its
requests, memorials, register and map entries follow in pages of at most ``page_rows`` rows, whatever their
number, each with the place of its first row, so readers split a large cemetery and rows keep their order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotlink.functions.frames import union_all
from plotlink.functions.lineage import written
from plotlink.sources.feeds import MEMORIAL_POS, REGISTER_POS

#: Document field: column, in the order of the format.
REQUEST_FIELDS = {"prId": "prid", **{c: c for c in "mid fn ln name by dy bd dd plot notes req created lat lng claimed problem".split()}}
PAGE_ROWS = 20_000


def _placed(df: DataFrame, by: list[str], page_rows: int) -> DataFrame:
    """Dense position (``pos``) and page of every row within its group, by ``ord``: ordinal ranges are counted
    first, so the numbering inside a range is local to it."""
    r = df.withColumn("_b", F.floor(F.col("ord") / 1_000_000))
    per = r.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*by, "_b").orderBy("ord")
    placed = r.join(per, [*by, "_b"]).withColumn("pos", F.col("_base") + F.row_number().over(here) - 1).drop("_b", "_base")
    return placed.withColumn("page", F.floor(F.col("pos") / page_rows).cast("int"))


def _pages(df: DataFrame, by: list[str], page_rows: int, row: Column) -> DataFrame:
    """by, page, first, n, rows: the rows of each page as an array in their order."""
    return _placed(df, by, page_rows).groupBy(*by, "page").agg(
        F.min("pos").alias("first"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))), lambda x: x.r).alias("rows"))


def _listed(df: DataFrame, out: str, order: list[str], row: Column) -> DataFrame:
    """cem_id and one short array of a cemetery's facts."""
    return df.groupBy("cem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("_r")))), lambda x: x["_r"]).alias(out))


def _lines(df: DataFrame, order: list[str]) -> DataFrame:
    """cem_id, poly, line: the points of each outline or drive."""
    return df.groupBy("cem_id", "poly").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.array("lat", "lng").alias("_r")))), lambda x: x["_r"]).alias("line"))


def publish_bundle(tables: dict[str, DataFrame], generated: str = "", home: tuple[float, float] | None = None, radius: float | None = None, page_rows: int = PAGE_ROWS) -> DataFrame:
    """cem_id, kind, page, n, line. ``tables``: those that ``read_bundle`` gives; cemetery is needed, others may
    be missing. Lists that a cemetery has no rows of are left out."""
    cem = tables["cemetery"]
    strings = lambda cols: F.array(*[F.col(c).cast("string") for c in cols])
    top = [F.lit(2).alias("v"), F.col("page"), F.lit(generated).alias("generated")]
    top += [F.struct(F.lit(float(home[0])).alias("lat"), F.lit(float(home[1])).alias("lng")).alias("home")] if home else []
    top += [F.lit(float(radius)).alias("radiusMiles")] if radius is not None else []

    def lines(df, kind, *parts):
        one = F.struct(F.col("cem_id").alias("id"), *parts)
        return df.select("cem_id", F.lit(kind).alias("kind"), "page", F.col("n").cast("bigint").alias("n"), F.to_json(F.struct(*top, F.array(one).alias("cemeteries"))).alias("line"))

    docs, told = [], []
    for name, kind, row in (("request", "requests", lambda df: F.struct(*[F.col(c).alias(f) for f, c in REQUEST_FIELDS.items() if c in df.columns])),
                            ("memorial", "memorials", lambda df: strings(MEMORIAL_POS)), ("register", "roster", lambda df: strings(REGISTER_POS))):
        if (df := tables.get(name)) is not None:
            df = written(df, name)  # placed, paged and told below
            docs.append(lines(_pages(df, ["cem_id"], page_rows, row(df)), kind, "first", F.col("rows").alias(kind)))
            told.append(df.groupBy("cem_id").agg(F.count("*").alias("n")).select("cem_id", F.lit(kind).alias("kind"), "n", F.ceil(F.col("n") / page_rows).alias("pages")))
    maps, entry = tables.get("plat_map"), tables.get("plat_entry")
    if maps is not None and entry is not None:
        entry = entry.drop("cem_id").join(maps.select("map_id", "cem_id", F.col("map_ord").cast("int").alias("map_ord")), "map_id")
        entry = written(entry, "map-entries")
        part = F.array(F.struct(F.col("map_ord").alias("ord"), F.col("rows").alias("entries")))
        docs.append(lines(_pages(entry, ["cem_id", "map_ord"], page_rows, strings(["block", "lot", "x", "y"])), "entries", "first", part.alias("maps")))
        of_map = entry.groupBy("cem_id", "map_ord").agg(F.count("*").alias("n")).groupBy("cem_id").agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("n") / page_rows)).alias("pages"))
        told.append(of_map.select("cem_id", F.lit("entries").alias("kind"), "n", "pages"))

    # the facts of a cemetery: a few short lists
    facts, parts = cem, []
    if (section := tables.get("section")) is not None:
        of = section.groupBy("cem_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", F.struct("lat", "lng", "radius"))))).alias("sections"))
        facts, parts = facts.join(of, "cem_id", "left"), [*parts, "sections"]
    if maps is not None:
        sheet = F.struct(F.col("map_ord").cast("int").alias("ord"), "file", "section", "sub", "style", "quality", F.col("loo_median").alias("looMedian"), F.struct(*"abcdfg").alias("transform"))
        facts, parts = facts.join(_listed(maps, "maps", ["map_ord"], sheet), "cem_id", "left"), [*parts, "maps"]
    ground = []
    for name, field in (("ground_vertex", "bounds"), ("drive_vertex", "drives")):
        if (df := tables.get(name)) is not None:
            facts, ground = facts.join(_listed(_lines(df, ["v"]), field, ["poly"], F.col("line")), "cem_id", "left"), [*ground, field]
    if (gate := tables.get("gate")) is not None:
        facts, ground = facts.join(_listed(gate, "gates", ["gate"], F.array("lat", "lng")), "cem_id", "left"), [*ground, "gates"]
    if ground:
        some = F.coalesce(*[F.col(c).isNotNull() for c in ground[:1]], F.lit(False))
        for c in ground[1:]:
            some = some | F.col(c).isNotNull()
        parts.append(F.when(some, F.struct(*ground)).alias("grounds"))
    if told:
        manifest = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.struct("n", "pages")))))
        facts, parts = facts.join(union_all(told).groupBy("cem_id").agg(manifest.alias("manifest")), "cem_id", "left"), [*parts, "manifest"]
    optional = {"county": "county", "miles": "miles", "declination": "declination", "contact": "contact", "rosterAsOf": "register_as_of", "sgBlocks": "sg_blocks"}
    parts = ["name", "lat", "lng", *[F.col(c).alias(f) for f, c in optional.items() if c in cem.columns], *parts]
    meta = [F.col(c).alias(f) for f, c in {"memorialsAsOf": "as_of", "interments": "interments"}.items() if c in cem.columns]
    parts += [F.struct(*meta).alias("meta")] if meta else []
    docs.append(lines(facts.withColumns({"page": F.lit(0), "n": F.lit(1)}), "cemetery", *parts))
    return union_all(docs)


def write_bundle(docs: DataFrame, path: str) -> None:
    """Replaces exactly the cemeteries present in ``docs``; the others keep their files."""
    docs.select("cem_id", F.col("line").alias("value")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("cem_id").text(path)


def bundle_gaps(tables: dict[str, DataFrame]) -> DataFrame:
    """cem_id, kind, n, found of every list that a read bundle has not as many rows of as its manifest says."""
    kinds = {"requests": "request", "memorials": "memorial", "roster": "register", "entries": "plat_entry"}
    found = union_all([tables[t].groupBy("cem_id").agg(F.count("*").alias("found")).withColumn("kind", F.lit(k)) for k, t in kinds.items()])
    return tables["manifest"].select("cem_id", "kind", "n").join(found, ["cem_id", "kind"], "full").na.fill(0, ["n", "found"]).filter("n <> found").select("cem_id", "kind", "n", "found")


def dataset_totals(cemetery: DataFrame, request: DataFrame, memorial: DataFrame) -> DataFrame:
    """Counts per cemetery and one grand total (cem_id 0)."""
    q = request.groupBy("cem_id").agg(F.count("*").alias("requests"))
    m = memorial.groupBy("cem_id").agg(F.count("*").alias("memorials"), F.count("lat").alias("gps_anchors"))
    per = cemetery.select("cem_id").join(q, "cem_id", "left").join(m, "cem_id", "left").na.fill(0).withColumn("cemeteries", F.lit(1).cast("bigint"))
    cols = ["cemeteries", "requests", "memorials", "gps_anchors"]
    return per.select("cem_id", *cols).unionByName(per.agg(*[F.sum(c).alias(c) for c in cols]).select(F.lit(0).alias("cem_id"), *cols))
