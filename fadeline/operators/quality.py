"""Completeness of the received level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.functions.bands import panel_completeness_band
from fadeline.functions.numbers import percent
from fadeline.functions.times import in_range, minute_of


def minute_completeness(observations: DataFrame) -> DataFrame:
    """Valid and missing values per minute, in order."""
    return (
        observations.groupBy(minute_of("time").alias("minute"))
        .agg(F.count("rsl").alias("valid_count"), F.count_if(F.col("rsl").isNull()).alias("null_count"))
        .orderBy("minute")
    )


def quality_counts(observations: DataFrame, start=None, end=None) -> DataFrame:
    """Valid, missing and all records in a range."""
    return observations.where(in_range(observations, "time", start, end)).agg(
        F.count("rsl").alias("valid_count"),
        F.count_if(F.col("rsl").isNull()).alias("null_count"),
        F.count(F.lit(1)).alias("total_records"),
    )


def overall_completeness(observations: DataFrame, start=None, end=None) -> DataFrame:
    """Share of valid records in a range with its band; an empty range gives null."""
    counts = quality_counts(observations, start, end)
    share = percent(F.col("valid_count"), F.col("total_records"))
    return counts.select(
        share.alias("completeness_percent"), panel_completeness_band(share).alias("band")
    )
