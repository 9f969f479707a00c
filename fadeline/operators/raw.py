"""Listings and summaries of the raw observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fadeline.functions.text import contains_ci
from fadeline.functions.times import in_range, time_bucket
from fadeline.session import staged


def newest_since(rows: DataFrame, n: int, column: str = "time") -> Column:
    """Start of the newest hour from which on there are at least ``n`` rows (or
    all rows, if there are fewer).

    A top-n takes n candidates from each task; with this bound only the tasks
    that hold the newest hours have any.  The running sum orders one row per
    hour of the range.
    """
    hours = rows.groupBy(time_bucket(column).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    newer = F.sum("n").over(Window.orderBy(F.desc("hour"))) - F.col("n")
    return hours.select("hour", newer.alias("newer")).where(F.col("newer") < n).agg(F.min("hour")).scalar()


def newest_rows(observations: DataFrame, start=None, end=None, search: str | None = None, limit: int = 5000) -> DataFrame:
    """Newest rows in a range whose link id contains the search text."""
    rows = observations.where(in_range(observations, "time", start, end) & contains_ci(F.col("cml_id"), search))
    newest = rows.where(F.col("time") >= newest_since(rows, limit))
    return newest.orderBy(F.desc("time"), "user_id", "cml_id", "sublink_id").limit(limit)


def load_summary(observations: DataFrame) -> DataFrame:
    """First time, last time and number of rows."""
    return observations.agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count(F.lit(1)).alias("total_rows")
    )


def freshness(observations: DataFrame) -> DataFrame:
    return observations.agg(F.max("time").alias("latest"))


def sublinks_with_data(observations: DataFrame) -> DataFrame:
    """Sublinks with at least one value."""
    return observations.groupBy("sublink_id").agg(F.count("rsl").alias("n")).where("n > 0").select("sublink_id")


def keep_active_sublinks(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """Drop rows (data or metadata) of sublinks that never carry a value."""
    return rows.join(staged(sublinks_with_data(observations)), "sublink_id", "left_semi")
