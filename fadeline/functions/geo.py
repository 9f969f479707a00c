"""Geometry of a link between two sites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def site(lon: str, lat: str) -> Column:
    return F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat"))


def line_feature(cml_id: Column | str = "cml_id") -> Column:
    """GeoJSON LineString feature of a link, as text."""
    link = F.col(cml_id) if isinstance(cml_id, str) else cml_id
    ends = [F.array(F.col(f"site_{i}_lon"), F.col(f"site_{i}_lat")) for i in (0, 1)]
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("LineString").alias("type"), F.array(*ends).alias("coordinates")).alias("geometry"),
            F.struct(link.cast("string").alias("cml_id")).alias("properties"),
        )
    )
