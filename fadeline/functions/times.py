"""Times: tolerant parsing, zones, buckets, literals of the column's own type."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A time of day with an offset or a zone name behind it.
_OFFSET = r"\d{2}:\d{2}.*(Z|z|[+-]\d{2}(:?\d{2})?|[ \d](UTC|GMT|UT)([+-]\d{1,2}(:?\d{2})?)?|[A-Z][A-Za-z]+(/[A-Za-z_+-]+)+)$"


def as_datetime(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def moment(df: DataFrame, column: str, value: str | datetime) -> Column:
    """A literal in the type of ``df[column]``: no cast on the column, so the
    comparison still reaches the Parquet reader."""
    text = as_datetime(value).isoformat(sep=" ")
    return F.lit(text).cast(df.schema[column].dataType)


def in_range(df: DataFrame, column: str, start=None, end=None, end_inclusive: bool = True) -> Column:
    """Range test on a time column; both ends are inclusive unless told otherwise."""
    test = F.lit(True)
    if start is not None:
        test = F.col(column) >= moment(df, column, start)
    if end is not None:
        stop = moment(df, column, end)
        upper = F.col(column) <= stop if end_inclusive else F.col(column) < stop
        test = upper if start is None else test & upper
    return test


def time_bucket(time: Column | str, width: str = "1 hour") -> Column:
    """Start of the epoch-aligned bucket that holds ``time``."""
    return F.window(time, width)["start"]


def minute_of(time: Column | str) -> Column:
    return time_bucket(time, "1 minute")


def parse_time(text: Column) -> Column:
    """Text to timestamp, unreadable text to null.  Naive text is taken as UTC."""
    return F.trim(text).try_cast("timestamp")


def _utc(text: Column, parsed: Column, direct: Column, back: Column, zone: str, ambiguous: str) -> Column:
    """``parsed`` is the text as a timestamp, ``direct`` its plain conversion from
    ``zone`` and ``back`` that one converted back; they differ inside a gap."""
    skipped = back.cast("double") - parsed.cast("double")
    gap_start = F.when(skipped > 3600, F.date_trunc("day", parsed)).otherwise(F.date_trunc("hour", parsed))
    naive = F.when(skipped > 0, F.to_utc_timestamp(gap_start, zone)).otherwise(direct)
    if ambiguous == "null":
        twice = F.lit(False)
        for shift in ("30 minutes", "1 hour"):
            later = F.from_utc_timestamp(direct + F.expr(f"INTERVAL {shift}"), zone)
            twice = twice | (later == parsed)
        naive = F.when(~twice, naive)
    elif ambiguous != "earlier":
        raise ValueError(f"ambiguous must be 'earlier' or 'null', not {ambiguous!r}")
    return F.when(F.trim(text).rlike(_OFFSET), parsed).otherwise(naive)


def to_utc(text: Column, zone: str | None, ambiguous: str = "earlier") -> Column:
    """Text to a UTC timestamp.

    Text with an offset is only converted.  Naive text is local time in ``zone``:
    a time inside a spring gap moves to the first valid instant; a time that
    occurs twice in autumn takes the earlier instant, or null with
    ``ambiguous="null"``.
    """
    parsed = parse_time(text)
    if not zone:
        return parsed
    direct = F.to_utc_timestamp(parsed, zone)
    return _utc(text, parsed, direct, F.from_utc_timestamp(direct, zone), zone, ambiguous)


def column_to_utc(df: DataFrame, column: str, zone: str | None, ambiguous: str = "earlier") -> DataFrame:
    """``to_utc`` on a column of many rows: the text is parsed and converted in
    projections of their own, so that each is done once per row."""
    if not zone:
        return df.withColumn(column, parse_time(F.col(column)))
    steps = df.withColumn("parsed_time", parse_time(F.col(column)))
    steps = steps.withColumn("direct_time", F.to_utc_timestamp("parsed_time", zone))
    steps = steps.withColumn("back_time", F.from_utc_timestamp("direct_time", zone))
    parts = [F.col(c) for c in ("parsed_time", "direct_time", "back_time")]
    return steps.withColumn(column, _utc(F.col(column), *parts, zone, ambiguous)).drop("parsed_time", "direct_time", "back_time")


def whole_days(first: Column, last: Column) -> Column:
    """Complete 24 h periods between two times (not midnights crossed)."""
    return F.timestamp_diff("DAY", first, last)
