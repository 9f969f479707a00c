"""Ids and tenants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_ID = "nan"
DEFAULT_TENANT = "default"


def id_text(x: Column) -> Column:
    """Ids are text, kept as written; a missing link id is the text ``nan``."""
    return F.coalesce(x.cast("string"), F.lit(MISSING_ID))


def stored_sublink(x: Column) -> Column:
    """The text ``nan`` in a sublink id means missing."""
    text = x.cast("string")
    return F.when(text != MISSING_ID, text)


def tenant_or_default(x: Column, default: str = DEFAULT_TENANT) -> Column:
    return F.coalesce(x, F.lit(default))


def relabel(x: Column, names: dict[str, str]) -> Column:
    """Rename tenants by a map; names outside it stay."""
    if not names:
        return x
    pairs = [F.lit(v) for pair in names.items() for v in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), x), x)
