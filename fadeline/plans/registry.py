"""All registered queries."""

from fadeline.plans import queries_files, queries_links, queries_rows, queries_sources, queries_stats  # noqa: F401
from fadeline.plans.catalog import ORACLE, QUERIES  # noqa: F401
