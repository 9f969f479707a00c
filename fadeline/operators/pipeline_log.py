"""Reports on the file log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.bands import quarantine_alarm, user_quarantine_band
from fadeline.functions.numbers import percent
from fadeline.functions.text import contains_ci, short_error
from fadeline.functions.times import as_datetime, in_range, moment, time_bucket
from fadeline.schemas import STATUSES

PAGE_SIZE = 50


def _is(status: str) -> Column:
    return F.col("status") == status


def _rows_archived() -> Column:
    return F.coalesce(F.sum(F.when(_is("archived"), F.col("rows_written"))), F.lit(0))


def log_totals(log: DataFrame) -> DataFrame:
    """Files and rows over all time, and the share of archived files."""
    counts = log.agg(
        F.count_if(_is("archived")).alias("archived"),
        F.count_if(_is("quarantined")).alias("quarantined"),
        _rows_archived().alias("total_rows_written"),
    )
    files = F.col("archived") + F.col("quarantined")
    return counts.withColumn("success_rate", percent(F.col("archived"), files, 1))


def log_last_day(log: DataFrame, as_of) -> DataFrame:
    """The three figures of the last 24 hours in one pass, with the alarm."""
    since = moment(log, "processed_at", as_datetime(as_of) - timedelta(hours=24))
    quarantined = F.count_if(_is("quarantined"))
    return log.where(F.col("processed_at") >= since).agg(
        quarantined.alias("quarantined"),
        F.count_if(_is("archived")).alias("archived"),
        _rows_archived().alias("rows_written"),
        quarantine_alarm(quarantined).alias("alarm"),
    )


def log_by_user(log: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Per user over the last days; most recently active first."""
    since = moment(log, "processed_at", as_datetime(as_of) - timedelta(days=days))
    archived, quarantined, total = F.count_if(_is("archived")), F.count_if(_is("quarantined")), F.count(F.lit(1))
    return (
        log.where(F.col("processed_at") >= since)
        .groupBy("user_id")
        .agg(
            archived.alias("archived"),
            quarantined.alias("quarantined"),
            total.alias("total"),
            percent(archived, total, 1).alias("success_rate_pct"),
            _rows_archived().alias("rows_written"),
            F.max("processed_at").alias("last_activity"),
            user_quarantine_band(quarantined).alias("quarantine_band"),
        )
        .orderBy(F.desc("last_activity"), "user_id")
    )


def _hourly(log: DataFrame, status: str, value: Column, start, end) -> DataFrame:
    return (
        log.where(in_range(log, "processed_at", start, end) & _is(status))
        .groupBy(time_bucket("processed_at").alias("time"), "user_id")
        .agg(value)
        .orderBy("time", "user_id")
    )


def hourly_archived(log: DataFrame, start=None, end=None) -> DataFrame:
    return _hourly(log, "archived", F.count(F.lit(1)).alias("archived"), start, end)


def hourly_quarantined(log: DataFrame, start=None, end=None) -> DataFrame:
    return _hourly(log, "quarantined", F.count(F.lit(1)).alias("quarantined"), start, end)


def hourly_rows(log: DataFrame, start=None, end=None) -> DataFrame:
    return _hourly(log, "archived", F.coalesce(F.sum("rows_written"), F.lit(0)).alias("rows_written"), start, end)


def filtered_log(log: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    """Files of one status (an unknown status filters nothing) whose name
    contains the search text."""
    if status in STATUSES:
        log = log.where(_is(status))
    return log.where(contains_ci(F.col("filename"), (search or "").strip()))


def page_number(page) -> int:
    """A page below one, or not a number, is page one."""
    try:
        return max(1, int(page))
    except (TypeError, ValueError):
        return 1


def _shown(log: DataFrame) -> DataFrame:
    return log.select(
        "id", "user_id", "filename", "status", "rows_written", short_error(F.col("error_message")).alias("error_message"), "processed_at"
    )


def log_page(log: DataFrame, page=1, status=None, search=None, per_page: int = PAGE_SIZE) -> DataFrame:
    """One page of the log, newest first.  The id makes the order stable."""
    skip = (page_number(page) - 1) * per_page
    rows = filtered_log(log, status, search).orderBy(F.desc("processed_at"), F.desc("id"))
    return _shown((rows.offset(skip) if skip else rows).limit(per_page))


def log_page_after(log: DataFrame, processed_at, row_id: int, status=None, search=None, per_page: int = PAGE_SIZE) -> DataFrame:
    """The page that follows a known row.  Its cost does not grow with depth."""
    last = moment(log, "processed_at", processed_at)
    key = F.col("processed_at")
    older = (key < last) | ((key == last) & (F.col("id") < row_id))
    rows = filtered_log(log, status, search).where((key <= last) & older)
    return _shown(rows.orderBy(F.desc("processed_at"), F.desc("id")).limit(per_page))


def log_page_info(log: DataFrame, page=1, status=None, search=None, per_page: int = PAGE_SIZE) -> DataFrame:
    """Number of files, number of pages, and the page numbers offered around ``page``."""
    current = page_number(page)
    counted = filtered_log(log, status, search).agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint")
    return counted.select(
        "total",
        pages.alias("total_pages"),
        F.greatest(F.lit(1), F.lit(current - 2)).cast("bigint").alias("first_page_shown"),
        F.least(pages, F.lit(current + 2)).cast("bigint").alias("last_page_shown"),
    )


def recent_quarantined(log: DataFrame, start=None, end=None, limit: int = 200) -> DataFrame:
    """Newest quarantined files in a range with their error."""
    rows = log.where(in_range(log, "processed_at", start, end) & _is("quarantined"))
    return (
        rows.orderBy(F.desc("processed_at"), F.desc("id"))
        .limit(limit)
        .select("processed_at", "user_id", "filename", "error_message")
    )
