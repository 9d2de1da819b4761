"""All stages from raw tables to located requests, each built once.

A stage that several later ones read (standardised tables, links, anchors, located plots) is
written as a table in the session's checkpoint folder. Later plans then start from a short
scan with real statistics, and a lost executor costs nothing that was already finished.
"""

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotlink.functions.lineage import written
from plotlink.operators import anchors as an
from plotlink.operators import burials as bu
from plotlink.operators import linkage as lk
from plotlink.operators import maintain as mt
from plotlink.operators import standardize as std
from plotlink.plans import enrich, locate


class Model:
    """Raw inputs: cemetery, memorial, register, request, pin, plat_map, plat_entry,
    section_given, ground_vertex."""

    def __init__(self, raw: Mapping[str, DataFrame], sg_blocks=()):
        self.raw, self.sg_blocks, self._made = raw, sg_blocks, {}

    def _stage(self, name, build, keep=True):
        if name not in self._made:
            self._made[name] = written(build(), name) if keep else build()
        return self._made[name]

    @property
    def cemetery(self):
        return self._stage("cemetery", lambda: self.raw["cemetery"])

    @property
    def pins(self):
        return self._stage("pins", lambda: mt.latest_pins(self.raw["pin"], self.cemetery))

    @property
    def memorial(self):
        # texts are read where the raw rows lie, so a task's share of them does not follow the joins' partitions
        def build():
            text = written(std.memorial_table(self.raw["memorial"]), "memorial-text")
            m = std.clean_pins(text, self.cemetery).withColumns({"lat": F.col("pin_lat"), "lng": F.col("pin_lng")}) \
                .drop("pin_lat", "pin_lng", "reason", "e", "n")
            return mt.overlay_field_pins(m.withColumn("pk", F.col("mid").cast("string")), self.pins).drop("pk")

        return self._stage("memorial", build)

    @property
    def pinned(self):
        """Memorials with a position, and their plot parts: names are not read, nor the plots of rows without a pin."""
        def build():
            m = std.clean_pins(self.raw["memorial"].select("cem_id", "ord", "mid", "plot", "lat", "lng"), self.cemetery)
            m = m.select("cem_id", "ord", "mid", "plot", F.col("pin_lat").alias("lat"), F.col("pin_lng").alias("lng"))
            m = mt.overlay_field_pins(m.withColumn("pk", F.col("mid").cast("string")), self.pins).filter("lat IS NOT NULL")
            # dealt anew, so that the text work does not lie where small tables happened to be joined
            return std.standardize_plots(m.drop("pk").repartition("cem_id", "mid"))

        return self._stage("pinned", build)

    @property
    def register(self):
        return self._stage("register", lambda: std.register_table(self.raw["register"], self.sg_blocks))

    @property
    def register_pins(self):
        def build():
            g = self.pins.filter(F.col("pk").startswith("ros:")).select(
                "cem_id", F.substring("pk", 5, 99).try_cast("bigint").alias("key"), "lat", "lng")
            return self.register.join(g, ["cem_id", "key"])

        return self._stage("register_pins", build, keep=False)

    @property
    def request(self):
        return self._stage("request", lambda: std.request_table(self.raw["request"]))

    @property
    def links(self):
        return self._stage("links", lambda: lk.link_register_memorial(self.register, self.memorial))

    @property
    def claims(self):
        return self._stage("claims", lambda: lk.era_gated_link(self.register, self.memorial, self.links, self.cemetery))

    @property
    def linked(self):
        """Every register row that stands for a memorial, scored or claimed by era."""
        return self._stage("linked", lambda: self.links.filter("status = 'link'").select("cem_id", "key", "mid", "score")
                           .unionByName(self.claims.select("cem_id", "key", "mid", "score")), keep=False)

    @property
    def memorial_register(self):
        return self._stage("memorial_register", lambda: lk.best_register_per_memorial(self.links).unionByName(
            self.claims.select("cem_id", "mid", "key", "score")), keep=False)

    @property
    def request_links(self):
        marked = self.linked.withColumn("status", F.lit("link"))
        return self._stage("request_links", lambda: lk.request_links(self.request, self.register, self.memorial_register, marked))

    @property
    def anchor(self):
        return self._stage("anchor", lambda: an.gps_anchors(self.memorial, self.register_pins, self.cemetery).unionByName(
            an.register_anchors(self.register, self.linked, self.memorial, self.cemetery)))

    @property
    def drawn(self):
        def build():
            e = locate.project_entries(self.raw["plat_map"], self.raw["plat_entry"])
            full = std.project_plats(self.raw["plat_map"], self.raw["plat_entry"], self.cemetery)
            inside = bu.out_of_bounds_filter(full, self.raw["ground_vertex"])
            return inside.select(*e.columns)

        return self._stage("drawn", build)

    @property
    def walk_rows(self):
        return self._stage("walk_rows", lambda: an.fit_walk_rows(
            self.register, self.linked, self.memorial, self.register_pins, self.drawn, self.cemetery))

    @property
    def plat(self):
        return self._stage("plat", lambda: self.drawn.unionByName(an.dynamic_plat(self.walk_rows)), keep=False)

    @property
    def section(self):
        return self._stage("section", lambda: an.derive_sections(self.anchor, self.raw["section_given"], self.cemetery))

    @property
    def located(self):
        def build():
            cols = ["cem_id", "section", "sub", "block", "lot"]
            plots = self.memorial.select(*cols).unionByName(self.register.select(*cols)).unionByName(self.request.select(*cols))
            return locate.locate_plots(plots, self.plat, self.anchor, self.section, self.cemetery)

        return self._stage("located", build)

    @property
    def burial(self):
        return self._stage("burial", lambda: bu.burial_union(self.memorial, self.register, self.linked))

    @property
    def enriched(self):
        return self._stage("enriched", lambda: enrich.enrich_requests(
            self.request, self.memorial, self.register, self.request_links, self.located, self.cemetery))
