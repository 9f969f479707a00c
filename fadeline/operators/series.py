"""Shift, cut, replay and split of a time series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.times import as_datetime, moment, time_bucket
from fadeline.operators.raw import newest_since

STEPS_PER_DAY = 8640


def shift_to_end(series: DataFrame, as_of) -> DataFrame:
    """Move the series so that its last time is ``as_of``; spacing stays."""
    latest = series.agg(F.max("time")).scalar()
    return series.withColumn("time", moment(series, "time", as_of) - (latest - F.col("time")))


def last_days(series: DataFrame, days: int) -> DataFrame:
    """The last days before the newest time; zero or less keeps all."""
    if days <= 0:
        return series
    latest = series.agg(F.max("time")).scalar()
    return series.where(F.col("time") > latest - F.expr(f"INTERVAL {int(days)} DAYS"))


def last_steps(series: DataFrame, steps: int) -> DataFrame:
    """The newest distinct time steps (8640 of them are one day at 10 s)."""
    times = series.select("time").distinct()
    newest = times.where(F.col("time") >= newest_since(times, steps)).orderBy(F.desc("time")).limit(steps)
    return series.where(F.col("time") >= newest.agg(F.min("time")).scalar())


def replay(source: DataFrame, start, end, interval: timedelta, loop: timedelta, step: timedelta) -> DataFrame:
    """Play a regular source series on a new regular grid.

    Each grid time maps to elapsed time, modulo the loop length, modulo the
    source span, and from there to the source step.  The grid is made by
    ``spark.range``, so it is spread over the cluster however long it is, and
    meets the source in an equi-join on the step number.
    """
    begin, stop = as_datetime(start), as_datetime(end)
    micros = [int(x / timedelta(microseconds=1)) for x in (interval, loop, step)]
    interval_us, loop_us, step_us = micros
    count = int((stop - begin) / interval) + 1 if stop >= begin else 0

    first = source.agg(F.min("time")).scalar()
    ends = source.agg(F.timestamp_diff("MICROSECOND", F.min("time"), F.max("time"))).scalar()
    elapsed = F.col("id") * interval_us
    position = F.when(F.col("span") > 0, F.pmod(F.pmod(elapsed, F.lit(loop_us)), F.col("span"))).otherwise(0)
    grid = (
        source.sparkSession.range(count)
        .withColumn("span", ends)
        .select(
            (moment(source, "time", begin) + F.make_dt_interval(secs=(F.col("id") * interval_us / 1_000_000).cast("decimal(18,6)"))).alias("replay_time"),
            F.floor(position / step_us).alias("step_no"),
        )
    )
    numbered = source.withColumn("step_no", F.floor(F.timestamp_diff("MICROSECOND", first, F.col("time")) / step_us))
    return grid.join(numbered, "step_no").drop("step_no", "time").withColumnRenamed("replay_time", "time")


def period_file(time: Column | str, width: str) -> Column:
    """Name of the file that holds the period of ``time``."""
    return F.concat(F.lit("cml_data_"), F.date_format(time_bucket(time, width), "yyyyMMdd_HHmmss"), F.lit(".csv"))


def write_periods(series: DataFrame, path: str, width: str) -> None:
    """One folder of CSV files per period; empty periods do not occur.  A period that is
    written again takes the place of what was there, so a rerun changes nothing."""
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    named = series.withColumn("period_file", period_file("time", width))
    named.hint("rebalance", "period_file").write.partitionBy("period_file").mode("overwrite").options(
        partitionOverwriteMode="dynamic", header=True, timestampFormat=micros, timestampNTZFormat=micros
    ).csv(path)
