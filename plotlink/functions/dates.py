"""Year extraction from free-text dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotlink import config as C


def year_of(c: Column) -> Column:
    """First year 1600-2099 in the text, 0 when there is none."""
    y = F.regexp_extract(F.coalesce(c, F.lit("")), C.YEAR, 1)
    return F.coalesce(y.try_cast("int"), F.lit(0))
