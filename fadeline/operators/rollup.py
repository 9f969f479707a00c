"""Hourly rollup, its refresh window, and the choice between rollup and raw."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.times import as_datetime, in_range, moment, time_bucket

ROLLUP_KEYS = ["bucket", "user_id", "cml_id", "sublink_id"]
START_OFFSET = timedelta(days=2)
END_OFFSET = timedelta(hours=1)
RAW_LIMIT = timedelta(days=3)


def hourly_rollup(observations: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of both levels per hour and sublink."""
    return observations.groupBy(
        time_bucket("time").alias("bucket"), "user_id", "cml_id", "sublink_id"
    ).agg(
        F.min("rsl").alias("rsl_min"),
        F.max("rsl").alias("rsl_max"),
        F.avg("rsl").alias("rsl_avg"),
        F.min("tsl").alias("tsl_min"),
        F.max("tsl").alias("tsl_max"),
        F.avg("tsl").alias("tsl_avg"),
    )


def _floor_hour(t: datetime) -> datetime:
    return t.replace(minute=0, second=0, microsecond=0)


def refresh_window(as_of) -> tuple[datetime, datetime]:
    """[start, end) of the whole hours inside [as_of - 2 d, as_of - 1 h]."""
    now = as_datetime(as_of)
    low = now - START_OFFSET
    start = _floor_hour(low)
    if start < low:
        start += timedelta(hours=1)
    return start, _floor_hour(now - END_OFFSET)


def refreshed_buckets(observations: DataFrame, as_of) -> DataFrame:
    """The rollup of the refresh window only: the part a refresh rewrites."""
    start, end = refresh_window(as_of)
    return hourly_rollup(observations.where(in_range(observations, "time", start, end, end_inclusive=False)))


def refresh_rollup(published: DataFrame, observations: DataFrame, as_of) -> DataFrame:
    """Published rollup after a refresh: buckets in the window come from the
    data, all others stay as they were, late data for them is not picked up."""
    start, end = refresh_window(as_of)
    inside = in_range(published, "bucket", start, end, end_inclusive=False)
    return published.where(~inside).unionByName(refreshed_buckets(observations, as_of))


def rollup_with_tail(published: DataFrame, observations: DataFrame, horizon, start=None, end=None) -> DataFrame:
    """Published buckets before ``horizon`` and buckets computed now after it."""
    old = published.where(F.col("bucket") < moment(published, "bucket", horizon))
    tail = hourly_rollup(observations.where(F.col("time") >= moment(observations, "time", horizon)))
    both = old.unionByName(tail)
    return both.where(in_range(both, "bucket", start, end))


def resolve_source(start, end) -> str:
    """``rollup`` for ranges beyond three days, else ``raw``."""
    return "rollup" if as_datetime(end) - as_datetime(start) > RAW_LIMIT else "raw"


def active_sublinks(rollup: DataFrame, start=None, end=None) -> DataFrame:
    """Sublinks with data per hour."""
    return (
        rollup.where(in_range(rollup, "bucket", start, end))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("sublinks"))
        .orderBy("bucket")
    )


def approximate_points(rollup: DataFrame, start=None, end=None, points_per_hour: int = 360) -> DataFrame:
    """Estimated observations per hour: sublinks times the reporting rate."""
    counts = active_sublinks(rollup, start, end)
    return counts.select("bucket", (F.col("sublinks") * points_per_hour).alias("data_points"))


def time_range(rollup: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First and last bucket, both null when there is none."""
    return rollup.groupBy(*(by or [])).agg(
        F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket")
    )


def iso_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
