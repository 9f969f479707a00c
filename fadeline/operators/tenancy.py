"""Tenant scopes.

A scope is a filter on the partition column ``user_id``: it prunes partitions
and keeps reports apart.  It is no security boundary; who may read which files
is for the storage system to say.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.functions.identity import DEFAULT_TENANT, relabel, tenant_or_default


@dataclass(frozen=True)
class TenantScope:
    """Rows of one tenant.  An unknown tenant is an error before any query."""

    user_id: str
    known: frozenset[str] = field(default_factory=frozenset)

    def __post_init__(self):
        if self.user_id not in self.known:
            raise ValueError(f"Unknown user_id: {self.user_id!r}")

    def table(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("user_id") == self.user_id)

    def stamp(self, df: DataFrame) -> DataFrame:
        return df.withColumn("user_id", F.lit(self.user_id))

    def check_write(self, df: DataFrame) -> DataFrame:
        """Rows with ``accepted`` and, for a foreign or missing tenant, a ``reason``."""
        own = F.coalesce(F.col("user_id") == self.user_id, F.lit(False))
        reason = F.concat(F.lit("row belongs to "), F.coalesce("user_id", F.lit("nobody")))
        return df.withColumn("accepted", own).withColumn("reason", F.when(~own, reason))


@dataclass(frozen=True)
class AdminScope:
    """Rows of all tenants, for reading only."""

    def table(self, df: DataFrame) -> DataFrame:
        return df


def relabel_tenants(df: DataFrame, names: dict[str, str], default: str = DEFAULT_TENANT) -> DataFrame:
    """Fill a missing tenant with the default, then rename tenants by the map."""
    return df.withColumn("user_id", relabel(tenant_or_default(F.col("user_id"), default), names))
