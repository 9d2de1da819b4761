"""Imports every catalog module so that its queries are registered."""

from plotlink.catalog import standard, links, places, people, streams, intake, maps  # noqa: F401
from plotlink.catalog.registry import QUERIES, SQL, oracle_text  # noqa: F401
