"""Registration of queries and of their SQL twins."""

from plotlink.catalog import fixtures
from plotlink.catalog.views import with_views

QUERIES = {}
SQL = {}
VIEWS = dict(fixtures.VIEWS)


class Tables:
    """Fixture tables by attribute: ``t.memorial`` is the derived memorial table."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        return fixtures.fixture(self.spark, self.sf_dir, f"fx_{name}", VIEWS)

    def raw(self, name):
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(slug):
    def keep(fn):
        QUERIES[slug] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        return fn

    return keep


def oracle(slug, sql):
    SQL[slug] = sql


def view(name, sql):
    VIEWS[name] = sql


def oracle_text(slug):
    return with_views(SQL[slug], VIEWS, "duckdb")


INPUTS = "cemetery memorial register request pin plat_map plat_entry section_given ground_vertex".split()
_MODELS = {}


class Inputs(dict):
    """The model's input tables, each parsed and analysed when a stage first reads it."""

    def __init__(self, t):
        self.t = t

    def __missing__(self, name):
        if name not in INPUTS:
            raise KeyError(name)
        self[name] = getattr(self.t, name)
        return self[name]


def model(t, fresh: bool = False):
    """The stage model over a scale-factor directory, shared by the queries of a session."""
    from plotlink.plans.model import Model

    key = (id(t.spark), t.spark.sparkContext.applicationId, t.sf_dir)
    if fresh or key not in _MODELS:
        made = Model(Inputs(t))
        if fresh:
            return made
        _MODELS[key] = made
    return _MODELS[key]
