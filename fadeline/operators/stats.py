"""Link statistics: lifetime, windowed, last value, mergeable partials.

All of them aggregate twice: first per sublink, where every buffer is a plain
number and Spark can hash-aggregate on the map side, then per link over the few
rows that are left.  A link that holds a third of all rows therefore costs no
more than any other, and the last value can be tied by sublink without sorting
the raw data.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.numbers import half_up, percent
from fadeline.functions.times import as_datetime, moment, time_bucket
from fadeline.schemas import LIFETIME_COLUMNS, STATS_KEY, WINDOW_COLUMNS

LINK_KEYS = ["user_id", "cml_id"]
SUBLINK_KEYS = ["user_id", "cml_id", "sublink_id"]
#: Windows are made of stretches of this length.
PANE = "1 minute"


def _moments(x: Column, suffix: str = "") -> list[Column]:
    """Count, sum and squared deviations of ``x``: enough to merge variances."""
    return [
        F.count(x).alias(f"n_valid{suffix}"),
        F.sum(x.cast("double")).alias(f"sum_rsl{suffix}"),
        (F.var_pop(x.cast("double")) * F.count(x)).alias(f"m2{suffix}"),
    ]


def _merged_mean(suffix: str = "") -> Column:
    return F.sum(f"sum_rsl{suffix}") / F.when(F.sum(f"n_valid{suffix}") > 0, F.sum(f"n_valid{suffix}"))


def _merged_stddev(suffix: str = "") -> Column:
    """Sample standard deviation of merged groups, null below two values.

    Sum of squares about the common mean = squares inside the groups + squares
    of the group means.  Signal levels lie within some hundred dB, so the
    subtraction keeps about twelve digits.
    """
    n, s = F.col(f"n_valid{suffix}"), F.col(f"sum_rsl{suffix}")
    inside = F.sum(F.coalesce(F.col(f"m2{suffix}"), F.lit(0.0)))
    between = F.sum(F.when(n > 0, s * s / n)) - F.sum(s) * F.sum(s) / F.when(F.sum(n) > 0, F.sum(n))
    variance = F.greatest(inside + between, F.lit(0.0)) / F.when(F.sum(n) > 1, F.sum(n) - 1)
    return F.sqrt(variance)


def _last(value: str = "last_rsl") -> Column:
    """Value at the newest time; it may be null.  Equal times: highest sublink."""
    return F.max_by(value, F.struct("last_time", "sublink_id"))


def partials(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mergeable statistics per sublink, and per further columns such as ``date``."""
    return observations.groupBy(*SUBLINK_KEYS, *(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        *_moments(F.col("rsl")),
        F.min("rsl").alias("min_rsl"),
        F.max("rsl").alias("max_rsl"),
        F.max("time").alias("last_time"),
        F.max_by("rsl", "time").alias("last_rsl"),
    )


def daily_partials(observations: DataFrame) -> DataFrame:
    """Partials per day, so that a new batch only replaces the days it touches."""
    return partials(observations.withColumn("date", F.to_date("time")), ["date"])


def folded(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Partials of the same sublink, and of the same ``by``, made one.

    Squared deviations are those inside the parts and those of the parts' means
    about the common one.
    """
    n, s = F.col("n_valid"), F.col("sum_rsl")
    between = F.sum(F.when(n > 0, s * s / n)) - F.sum(s) * F.sum(s) / F.when(F.sum(n) > 0, F.sum(n))
    return parts.groupBy(*SUBLINK_KEYS, *(by or [])).agg(
        F.sum("n").alias("n"),
        F.sum(n).alias("n_valid"),
        F.sum(s).alias("sum_rsl"),
        F.greatest(F.sum(F.coalesce("m2", F.lit(0.0))) + F.coalesce(between, F.lit(0.0)), F.lit(0.0)).alias("m2"),
        F.min("min_rsl").alias("min_rsl"),
        F.max("max_rsl").alias("max_rsl"),
        F.max("last_time").alias("last_time"),
        F.max_by("last_rsl", "last_time").alias("last_rsl"),
    )


def merge_partials(parts: DataFrame) -> DataFrame:
    """Lifetime statistics per link from partials of any cut."""
    n, valid = F.sum("n"), F.sum("n_valid")
    return parts.groupBy(*LINK_KEYS).agg(
        n.alias("total_records"),
        valid.alias("valid_records"),
        (n - valid).alias("null_records"),
        percent(valid, n).alias("completeness_percent"),
        F.min("min_rsl").alias("min_rsl"),
        F.max("max_rsl").alias("max_rsl"),
        half_up(_merged_mean()).alias("mean_rsl"),
        half_up(_merged_stddev()).alias("stddev_rsl"),
        _last().alias("last_rsl"),
        F.max("last_time").alias("last_time"),
    )


def lifetime_stats(observations: DataFrame) -> DataFrame:
    """Lifetime statistics of every link that has data."""
    return merge_partials(partials(observations)).drop("last_time")


def last_values(observations: DataFrame) -> DataFrame:
    """Time and value of the newest observation per link."""
    per_sublink = observations.groupBy(*SUBLINK_KEYS).agg(
        F.max("time").alias("last_time"), F.max_by("rsl", "time").alias("last_rsl")
    )
    return per_sublink.groupBy(*LINK_KEYS).agg(
        F.max("last_time").alias("last_time"), _last().alias("last_rsl")
    )


def last_of_partials(parts: DataFrame) -> DataFrame:
    """The same from stored partials."""
    return parts.groupBy(*LINK_KEYS).agg(_last().alias("last_rsl"), F.max("last_time").alias("last_time"))


def windowed_stats(observations: DataFrame, links: DataFrame, as_of, last: DataFrame | None = None) -> DataFrame:
    """Statistics of the last 6 h and 1 h for every link of ``links``.

    The windows have an inclusive lower bound and no upper bound.  Silent links
    get zero counts and null means.  The last value looks at all history.  Give
    ``last`` (``last_values`` or stored statistics with ``last_time`` and
    ``last_rsl``) to read the newest six hours only; without it one pass over
    all observations yields both.
    """
    now = as_datetime(as_of)
    six = moment(observations, "time", now - timedelta(hours=6))
    one = moment(observations, "time", now - timedelta(hours=1))
    source = observations.where(F.col("time") >= six) if last is not None else observations
    in_6h, in_1h = F.col("time") >= six, F.col("time") >= one
    rsl_6h, rsl_1h = F.when(in_6h, F.col("rsl")), F.when(in_1h, F.col("rsl"))

    per_sublink = source.groupBy(*SUBLINK_KEYS).agg(
        F.count_if(in_6h).alias("n_6h"),
        F.count_if(in_1h).alias("n_1h"),
        *_moments(rsl_6h, "_6h"),
        *_moments(rsl_1h, "_1h"),
        F.max("time").alias("last_time"),
        F.max_by("rsl", "time").alias("last_rsl"),
    )
    return _windowed(per_sublink, links, last)


def panes(observations: DataFrame) -> DataFrame:
    """Partials of every minute: what the windows are made of."""
    return partials(observations.withColumn("minute", time_bucket("time", PANE)), ["minute"])


def windowed_from_panes(parts: DataFrame, links: DataFrame, as_of, last: DataFrame | None = None) -> DataFrame:
    """``windowed_stats`` from ``panes`` of the last six hours, 360 to a sublink at most.

    ``as_of`` is a whole minute: the lower bound of a window is then the begin of a
    pane.  Without ``last``, ``parts`` holds the panes of all history.
    """
    now = as_datetime(as_of)
    if now.second or now.microsecond:
        raise ValueError(f"panes begin at whole minutes, not at {now}")
    six = moment(parts, "minute", now - timedelta(hours=6))
    one = moment(parts, "minute", now - timedelta(hours=1))
    source = parts.where(F.col("minute") >= six) if last is not None else parts
    columns = [
        F.when(F.col("minute") >= since, F.col(c)).alias(f"{c}{suffix}")
        for suffix, since in (("_6h", six), ("_1h", one))
        for c in ("n", "n_valid", "sum_rsl", "m2")
    ]
    return _windowed(source.select(*SUBLINK_KEYS, *columns, "last_time", "last_rsl"), links, last)


def _windowed(parts: DataFrame, links: DataFrame, last: DataFrame | None) -> DataFrame:
    windowed = parts.groupBy(*LINK_KEYS).agg(
        percent(F.sum("n_valid_6h"), F.sum("n_6h")).alias("completeness_percent_6h"),
        F.coalesce(F.sum("n_6h"), F.lit(0)).alias("total_records_6h"),
        F.coalesce(F.sum("n_valid_6h"), F.lit(0)).alias("valid_records_6h"),
        half_up(_merged_mean("_6h")).alias("mean_rsl_6h"),
        half_up(_merged_stddev("_6h")).alias("stddev_rsl_6h"),
        percent(F.sum("n_valid_1h"), F.sum("n_1h")).alias("completeness_percent_1h"),
        half_up(_merged_mean("_1h")).alias("mean_rsl_1h"),
        half_up(_merged_stddev("_1h")).alias("stddev_rsl_1h"),
        _last().alias("last_rsl"),
        F.max("last_time").alias("last_time"),
    )
    result = links.select(*LINK_KEYS).distinct().join(windowed, LINK_KEYS, "left")
    last_rsl = F.col("last_rsl")
    if last is not None:
        known = last.select(*LINK_KEYS, F.col("last_time").alias("known_time"), F.col("last_rsl").alias("known_rsl"))
        result = result.join(known, LINK_KEYS, "left")
        last_rsl = F.when(F.col("last_time").isNull() | (F.col("known_time") > F.col("last_time")), F.col("known_rsl")).otherwise(last_rsl)
    return result.select(
        *LINK_KEYS,
        "completeness_percent_6h",
        F.coalesce("total_records_6h", F.lit(0)).alias("total_records_6h"),
        F.coalesce("valid_records_6h", F.lit(0)).alias("valid_records_6h"),
        *[c for c in WINDOW_COLUMNS if c not in ("completeness_percent_6h", "total_records_6h", "valid_records_6h")],
        last_rsl.alias("last_rsl"),
    )


def only_links(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """Partials of the links in ``ids`` (user_id, cml_id).  Taking partials here
    and not raw rows keeps a hot link out of the join."""
    return parts.join(ids.select(*LINK_KEYS).distinct(), LINK_KEYS, "left_semi")


def refresh_links(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """Lifetime statistics recomputed for a set of links: those of a batch, or
    all links of a tenant's metadata."""
    return merge_partials(only_links(partials(observations), ids)).drop("last_time")


def upsert_stats(stored: DataFrame, incoming: DataFrame, as_of) -> DataFrame:
    """Write one group of statistics columns and leave the other group alone.

    ``incoming`` holds the lifetime or the windowed columns (plus ``last_rsl``);
    ``stored`` holds all.  Links new in ``incoming`` get nulls elsewhere.
    """
    values = [*LIFETIME_COLUMNS, *WINDOW_COLUMNS, "last_rsl", "last_update"]
    stamp = F.lit(as_datetime(as_of).isoformat(sep=" ")).cast(stored.schema["last_update"].dataType)
    new = incoming.withColumn("last_update", stamp).withColumn("is_new", F.lit(True))
    written = [c for c in values if c in new.columns]
    joined = stored.alias("old").join(new.alias("new"), STATS_KEY, "full_outer")
    columns = [
        F.when(F.col("new.is_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        if c in written
        else F.col(f"old.{c}").alias(c)
        for c in values
    ]
    return joined.select(*STATS_KEY, *columns)


def empty_stats(lifetime: DataFrame, as_of) -> DataFrame:
    """A full statistics row per link that so far has lifetime columns only."""
    kinds = {c: "bigint" if "records" in c else "double" for c in WINDOW_COLUMNS}
    return lifetime.select(
        *STATS_KEY,
        *LIFETIME_COLUMNS,
        *[F.lit(None).cast(kinds[c]).alias(c) for c in WINDOW_COLUMNS],
        "last_rsl",
        F.lit(as_datetime(as_of).isoformat(sep=" ")).cast("timestamp_ntz").alias("last_update"),
    )
