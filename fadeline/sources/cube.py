"""Dense arrays unrolled to rows.

The input is a table of blocks.  A block holds the ids of its axes and the
levels as arrays nested in the order of the dimensions, so a large array is cut
along time into many rows and unrolled in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.geo import haversine_m
from fadeline.functions.numbers import finite
from fadeline.operators.raw import keep_active_sublinks
from fadeline.schemas import COORDINATES

# The two orders of dimensions.
SUBLINK_FIRST = ("sublink_id", "cml_id", "time")
LINK_FIRST = ("cml_id", "sublink_id", "time")
_AXIS = {"sublink_id": "sublink_ids", "cml_id": "cml_ids", "time": "times"}


def to_rows(blocks: DataFrame, dims: tuple[str, str, str], rsl: str = "rsl", tsl: str = "tsl") -> DataFrame:
    """Block rows to (time, cml_id, sublink_id, tsl, rsl).

    Each step opens one dimension, pairing its ids with the arrays below it.
    """
    if dims not in (SUBLINK_FIRST, LINK_FIRST):
        raise ValueError(f"unknown order of dimensions {dims}")
    left = blocks.select(*_AXIS.values(), F.col(rsl).alias("r"), F.col(tsl).alias("t"))
    opened: list[str] = []
    for dim in dims:
        ids = _AXIS[dim]
        rest = [c for c in left.columns if c not in (ids, "r", "t")]
        pairs = F.arrays_zip(F.col(ids).alias(dim), F.col("r").alias("r"), F.col("t").alias("t"))
        left = left.select(*rest, F.inline(pairs).alias(dim, "r", "t"))
        opened.append(dim)
    return left.select(
        "time",
        F.col("cml_id").cast("string").alias("cml_id"),
        F.col("sublink_id").cast("string").alias("sublink_id"),
        finite(F.col("t")).alias("tsl"),
        finite(F.col("r")).alias("rsl"),
    )


def valid_rows(blocks: DataFrame, dims: tuple[str, str, str], **names) -> DataFrame:
    """Unrolled rows without the sublinks that are padding: those with no value at any time."""
    rows = to_rows(blocks, dims, **names)
    return keep_active_sublinks(rows, rows).select(rows.columns)


def _cell(matrix: str, dims: tuple[str, str]) -> Column:
    first, second = ("j", "i") if dims[0] == "sublink_id" else ("i", "j")
    return F.col(matrix)[F.col(first)][F.col(second)]


def metadata_rows(
    block: DataFrame,
    sublinks: DataFrame | None = None,
    frequency_dims: tuple[str, str] = ("cml_id", "sublink_id"),
    polarization_dims: tuple[str, str] = ("cml_id", "sublink_id"),
) -> DataFrame:
    """Metadata arrays to one row per link and sublink.

    Site arrays have one value per link and repeat over sublinks.  Without a
    length it is the distance of the sites; without a polarization it is null.
    ``sublinks`` (sublink_id) keeps the valid ones only.
    """
    columns = set(block.columns)
    links = block.select("*", F.posexplode("cml_ids").alias("i", "cml_id"))
    cells = links.select("*", F.posexplode("sublink_ids").alias("j", "sublink_id"))
    sites = [F.col(c)[F.col("i")].cast("double").alias(c) for c in COORDINATES]
    rows = cells.select(
        F.col("cml_id").cast("string").alias("cml_id"),
        F.col("sublink_id").cast("string").alias("sublink_id"),
        *sites,
        _cell("frequency", frequency_dims).cast("double").alias("frequency"),
        (_cell("polarization", polarization_dims).cast("string") if "polarization" in columns else F.lit(None).cast("string")).alias("polarization"),
        (F.col("length")[F.col("i")].cast("double") if "length" in columns else F.lit(None).cast("double")).alias("length"),
    )
    if "length" not in columns:
        rows = rows.withColumn("length", haversine_m(*[F.col(c) for c in COORDINATES]))
    if sublinks is not None:
        rows = rows.join(sublinks, "sublink_id", "left_semi").select(rows.columns)
    return rows
