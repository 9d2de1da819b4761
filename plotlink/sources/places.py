"""Cemetery listings, map elements, lot grids and photo files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.functions import geo, outline
from plotlink.functions.frames import union_all


def discover_cemeteries(listing: DataFrame, home: tuple[float, float], radius_miles: float, pinned: list[int]) -> DataFrame:
    """Listings of several counties to the cemeteries worth serving: the first listing that
    has a position counts, and it must be pinned, or near with open requests."""
    cols = ["name", "county", "lat", "lng", "interments", "photo_requests"]
    df = listing.filter("lat IS NOT NULL AND lat <> 0").groupBy("cem_id").agg(F.min_by(F.struct(*cols), "ord").alias("c")).select("cem_id", "c.*")
    miles = F.round(geo.haversine(F.lit(home[0]), F.lit(home[1]), F.col("lat"), F.col("lng"), C.EARTH_MILES), 1)
    df = df.withColumn("miles", miles)
    return df.filter(F.col("cem_id").isin(*pinned) | ((F.col("miles") <= radius_miles) & (F.col("photo_requests") > 0))).orderBy("miles", "cem_id")


def _touching(points: DataFrame, bounds: DataFrame, cemetery: DataFrame, pad: float) -> DataFrame:
    """Points with ``touch``: inside an outline, or near one of its vertices. Cemeteries without an outline
    use their centroid as the only vertex."""
    key = ["cem_id", "el_id", "v"]
    bare = cemetery.join(bounds.select("cem_id").distinct(), "cem_id", "left_anti").select("cem_id", "lat", "lng", F.lit(False).alias("has_area"))
    # an outline of one vertex has no area
    areas = bounds.groupBy("cem_id", "el_id").agg((F.count("*") > 1).alias("a")).groupBy("cem_id").agg(F.max("a").alias("has_area"))
    hit = outline.inside(points, outline.edges_of(bounds, "el_id"), key).unionByName(
        outline.near_vertex(points, bounds.select("cem_id", "lat", "lng").unionByName(bare.select("cem_id", "lat", "lng")), key, pad)).distinct()
    known = areas.unionByName(bare.select("cem_id", "has_area"))
    return points.join(known, "cem_id").join(hit.withColumn("touch", F.lit(True)), key, "left").withColumn("touch", F.coalesce("touch", F.lit(False)))


def classify_grounds(elements: DataFrame, cemetery: DataFrame, pad: float = 0.0006) -> DataFrame:
    """Map elements (cem_id, el_id, type, landuse, amenity, highway, v, lat, lng - one row per
    vertex) to bounds, drives and gates. A drive stays when enough of it touches the grounds,
    a gate when it touches them (or lies near the centroid where no outline is known)."""
    way = F.col("type") == "way"
    area = way & ((F.coalesce("landuse", F.lit("")) == "cemetery") | (F.coalesce("amenity", F.lit("")) == "grave_yard"))
    el = elements.withColumn("kind", F.when(area, "bound").when(way & F.col("highway").isNotNull(), "drive").when(F.col("type") == "node", "gate"))
    cem = cemetery.select("cem_id", "lat", "lng")
    bounds = el.filter("kind = 'bound'").select("cem_id", "el_id", "v", "lat", "lng")
    drives = _touching(el.filter("kind = 'drive'").select("cem_id", "el_id", "v", "lat", "lng"), bounds, cem, pad)
    drives = drives.groupBy("cem_id", "el_id").agg(F.count_if("touch").alias("n_touch"), F.count("*").alias("n_points")) \
        .filter(F.col("n_touch") >= F.greatest(F.lit(2.0), F.col("n_points") * 0.4))
    gates = _touching(el.filter("kind = 'gate'").select("cem_id", "el_id", "v", "lat", "lng"), bounds, cem, pad)
    center = cem.select("cem_id", F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    gates = gates.join(center, "cem_id").filter(
        F.when(F.col("has_area"), F.col("touch")).otherwise(F.abs(F.col("lat") - F.col("_a")) + F.abs(F.col("lng") - F.col("_b")) < 0.004))
    kept = union_all([
        bounds.groupBy("cem_id", "el_id").agg(F.count("*").alias("n_points")).withColumn("kind", F.lit("bound")),
        drives.select("cem_id", "el_id", "n_points", F.lit("drive").alias("kind")),
        gates.select("cem_id", "el_id", F.lit(1).cast("bigint").alias("n_points"), F.lit("gate").alias("kind"))])
    return kept.select("cem_id", "kind", "el_id", "n_points")


def grid_cells_to_lots(cells: DataFrame) -> DataFrame:
    """Spreadsheet cells (sheet, ref, value) that hold a lot number, with the column letters
    as a number and how many lots their sheet has."""
    val = F.trim("value")
    df = cells.filter(val.rlike(r"^\d{1,4}[A-Z]?$"))
    letters = F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 1)
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(a * 26 + F.ascii(ch) - 64))
    lot = F.regexp_replace(F.regexp_extract(val, r"^(\d{1,4})", 1), "^0+", "")
    df = df.select("sheet", F.when(lot == "", "0").otherwise(lot).alias("lot"), F.regexp_extract(val, r"([A-Z]?)$", 1).alias("suffix"),
                   col.alias("col"), F.regexp_extract("ref", r"(\d+)$", 1).cast("int").alias("row"))
    return df.join(df.groupBy("sheet").agg(F.count("*").alias("n_sheet")), "sheet")


def read_photo_files(spark: SparkSession, path: str) -> DataFrame:
    """File listing of a photo folder; the bytes themselves are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.unix_millis("modificationTime").alias("ts"), F.col("length").alias("size"))


def photo_inventory(files: DataFrame) -> DataFrame:
    """Photo files (file, ts, size) to grave key and slot, newest first; thumbnails left out."""
    base = F.regexp_replace("file", r"\.jpg$", "")
    df = files.filter(F.col("file").endswith(".jpg") & ~F.col("file").endswith(".thumb.jpg"))
    slot = F.regexp_extract(base, r"-(\d{1,3})$", 1)
    pk = F.regexp_replace(F.regexp_replace(base, r"-\d{1,3}$", ""), "^(.*?)ros_", "$1ros:")
    return df.select(pk.alias("pk"), F.coalesce(slot.try_cast("int"), F.lit(0)).alias("slot"), "ts", "size").orderBy(F.desc("ts"), "pk", "slot")
