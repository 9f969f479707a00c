"""Registered queries: statistics, rollup, quality, raw listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.functions.numbers import half_up
from fadeline.functions.times import moment, whole_days
from fadeline.operators import links as L
from fadeline.operators import quality, raw, rollup, stats
from fadeline.plans.catalog import half_up_sql as R
from fadeline.plans.catalog import query, with_views
from fadeline.plans.views import OBSERVATIONS_AS_OF, links, observations

AS_OF = f"TIMESTAMP '{OBSERVATIONS_AS_OF}'"
RANGE = ("2024-01-10 06:00:00", "2024-01-20 18:00:00")
IN_RANGE = f"BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'"

LAST = """last AS (SELECT user_id, cml_id, rsl AS last_rsl, time AS last_time FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id, cml_id ORDER BY time DESC, sublink_id DESC) AS rn FROM observations) WHERE rn = 1)"""
LIFETIME = f"""lifetime AS (SELECT user_id, cml_id, count(*) AS total_records, count(rsl) AS valid_records,
    count(*) - count(rsl) AS null_records, {R('100e0 * count(rsl) / count(*)')} AS completeness_percent,
    min(rsl) AS min_rsl, max(rsl) AS max_rsl, {R('avg(rsl)')} AS mean_rsl, {R('stddev_samp(rsl)')} AS stddev_rsl
    FROM observations GROUP BY user_id, cml_id)"""
WINDOWED = f"""windowed AS (SELECT l.user_id, l.cml_id,
    {R("100e0 * count(rsl) FILTER (WHERE w6) / nullif(count(*) FILTER (WHERE w6), 0)")} AS completeness_percent_6h,
    count(*) FILTER (WHERE w6) AS total_records_6h, count(rsl) FILTER (WHERE w6) AS valid_records_6h,
    {R("avg(rsl) FILTER (WHERE w6)")} AS mean_rsl_6h, {R("stddev_samp(rsl) FILTER (WHERE w6)")} AS stddev_rsl_6h,
    {R("100e0 * count(rsl) FILTER (WHERE w1) / nullif(count(*) FILTER (WHERE w1), 0)")} AS completeness_percent_1h,
    {R("avg(rsl) FILTER (WHERE w1)")} AS mean_rsl_1h, {R("stddev_samp(rsl) FILTER (WHERE w1)")} AS stddev_rsl_1h
    FROM (SELECT DISTINCT user_id, cml_id FROM links) l LEFT JOIN (SELECT *,
    time >= {AS_OF} - INTERVAL 6 HOUR AS w6, time >= {AS_OF} - INTERVAL 1 HOUR AS w1 FROM observations) o
    ON l.user_id = o.user_id AND l.cml_id = o.cml_id GROUP BY l.user_id, l.cml_id)"""
WINDOW_COLUMNS = "completeness_percent_6h, total_records_6h, valid_records_6h, mean_rsl_6h, stddev_rsl_6h, completeness_percent_1h, mean_rsl_1h, stddev_rsl_1h"
STATS_CTE = with_views("observations", "links") + "," + LAST + "," + WINDOWED


def rollup_sql(source: str = "observations", where: str = "true", views: bool = True) -> str:
    return f"""SELECT date_trunc('hour', time) AS bucket, user_id, cml_id, sublink_id, min(rsl) AS rsl_min, max(rsl) AS rsl_max,
    {R('avg(rsl)', 6)} AS rsl_avg, min(tsl) AS tsl_min, max(tsl) AS tsl_max, {R('avg(tsl)', 6)} AS tsl_avg
    FROM {source} WHERE {where} GROUP BY ALL"""


def rounded(rolled: DataFrame) -> DataFrame:
    """Means to six digits, so that the order of summation does not show."""
    return rolled.withColumns({c: half_up(F.col(c), 6) for c in ("rsl_avg", "tsl_avg")})


@query(with_views("observations") + f", {LAST}, {LIFETIME} SELECT lifetime.*, last_rsl FROM lifetime JOIN last USING (user_id, cml_id)")
def lifetime_stats(spark, sf_dir):
    return stats.lifetime_stats(observations(spark, sf_dir))


@query(with_views("observations") + f", {LAST}, {LIFETIME} SELECT lifetime.*, last_rsl FROM lifetime JOIN last USING (user_id, cml_id)")
def lifetime_stats_from_partials(spark, sf_dir):
    return stats.merge_partials(stats.daily_partials(observations(spark, sf_dir))).drop("last_time")


@query(
    with_views("observations", "links")
    + f", {LAST}, {LIFETIME} SELECT lifetime.*, last_rsl FROM lifetime JOIN last USING (user_id, cml_id) "
    "WHERE (user_id, cml_id) IN (SELECT (user_id, cml_id) FROM links)"
)
def refresh_known_links(spark, sf_dir):
    return stats.refresh_links(observations(spark, sf_dir), links(spark, sf_dir))


@query(STATS_CTE + f"SELECT user_id, cml_id, {WINDOW_COLUMNS}, last_rsl FROM windowed LEFT JOIN last USING (user_id, cml_id)")
def windowed_stats(spark, sf_dir):
    return stats.windowed_stats(observations(spark, sf_dir), links(spark, sf_dir), OBSERVATIONS_AS_OF)


@query(STATS_CTE + f"SELECT user_id, cml_id, {WINDOW_COLUMNS}, last_rsl FROM windowed LEFT JOIN last USING (user_id, cml_id)")
def windowed_stats_from_stored_last(spark, sf_dir):
    """Last values of the days before come from the partials, the newest six
    hours from the raw rows."""
    obs = observations(spark, sf_dir)
    known = stats.merge_partials(stats.daily_partials(obs.where(F.col("time") < moment(obs, "time", "2024-01-30"))))
    recent = obs.where(F.col("time") >= moment(obs, "time", "2024-01-30"))
    newest = stats.last_values(recent)
    both = known.select("user_id", "cml_id", "last_time", "last_rsl").unionByName(newest)
    last = both.groupBy("user_id", "cml_id").agg(F.max_by("last_rsl", "last_time").alias("last_rsl"), F.max("last_time").alias("last_time"))
    return stats.windowed_stats(obs, links(spark, sf_dir), OBSERVATIONS_AS_OF, last)


@query(with_views("observations") + f", {LAST} SELECT user_id, cml_id, last_time, last_rsl FROM last")
def last_value(spark, sf_dir):
    return stats.last_values(observations(spark, sf_dir))


_OLD = with_views("observations", "links") + f", {LAST}, {LIFETIME}, {WINDOWED}"


@query(
    _OLD
    + f"""SELECT coalesce(s.user_id, w.user_id) AS user_id, coalesce(s.cml_id, w.cml_id) AS cml_id, total_records, valid_records,
    null_records, completeness_percent, min_rsl, max_rsl, mean_rsl, stddev_rsl, {WINDOW_COLUMNS}, last_rsl,
    CASE WHEN w.cml_id IS NULL THEN TIMESTAMP '2024-01-30 00:00:00' ELSE {AS_OF} END AS last_update
    FROM lifetime s FULL JOIN windowed w ON s.user_id = w.user_id AND s.cml_id = w.cml_id
    LEFT JOIN last ON last.user_id = coalesce(s.user_id, w.user_id) AND last.cml_id = coalesce(s.cml_id, w.cml_id)"""
)
def stats_partial_upsert(spark, sf_dir):
    obs = observations(spark, sf_dir)
    stored = stats.empty_stats(stats.lifetime_stats(obs), "2024-01-30 00:00:00")
    return stats.upsert_stats(stored, stats.windowed_stats(obs, links(spark, sf_dir), OBSERVATIONS_AS_OF), OBSERVATIONS_AS_OF)


@query(
    STATS_CTE
    + f"""SELECT user_id, cml_id, completeness_percent_6h AS completeness_percent, total_records_6h AS total_records,
    valid_records_6h AS valid_records, mean_rsl_6h AS mean_rsl, stddev_rsl_6h AS stddev_rsl, completeness_percent_1h,
    stddev_rsl_1h AS stddev_last_60min, last_rsl FROM windowed LEFT JOIN last USING (user_id, cml_id)"""
)
def stats_listing(spark, sf_dir):
    return L.stats_listing(windowed_stats(spark, sf_dir))


@query(with_views("observations") + rollup_sql())
def hourly_rollup(spark, sf_dir):
    return rounded(rollup.hourly_rollup(observations(spark, sf_dir)))


_LATE = "tsl >= 80"


@query(
    with_views("observations")
    + f"SELECT * FROM ({rollup_sql(where='tsl < 80')}) WHERE bucket < {AS_OF} - INTERVAL 2 DAY UNION ALL "
    + rollup_sql(where=f"time >= {AS_OF} - INTERVAL 2 DAY AND time < {AS_OF} - INTERVAL 1 HOUR")
)
def rollup_refresh(spark, sf_dir):
    """Rows with a sent level from 80 on came late: a refresh sees them inside
    its window only."""
    obs = observations(spark, sf_dir)
    in_time = obs.where((F.col("tsl") < 80) & (F.col("time") < moment(obs, "time", "2024-01-30 12:00:00")))
    published = rollup.hourly_rollup(in_time)
    return rounded(rollup.refresh_rollup(published, obs, OBSERVATIONS_AS_OF))


@query(with_views("observations") + rollup_sql(where="time >= TIMESTAMP '2024-01-24 00:00:00'"))
def rollup_with_tail(spark, sf_dir):
    obs = observations(spark, sf_dir)
    horizon = "2024-01-30 23:00:00"
    published = rollup.hourly_rollup(obs.where(F.col("time") < moment(obs, "time", horizon)))
    return rounded(rollup.rollup_with_tail(published, obs, horizon, start="2024-01-24"))


@query(
    with_views("observations")
    + "SELECT date_trunc('minute', time) AS minute, count(rsl) AS valid_count, count(*) - count(rsl) AS null_count FROM observations GROUP BY 1"
)
def minute_completeness(spark, sf_dir):
    return quality.minute_completeness(observations(spark, sf_dir))


@query(
    with_views("observations")
    + f"""SELECT c AS completeness_percent, CASE WHEN c >= 90 THEN 'green' WHEN c >= 50 THEN 'yellow' WHEN c IS NOT NULL THEN 'red' END AS band
    FROM (SELECT {R('100e0 * count(rsl) / nullif(count(*), 0)')} AS c FROM observations WHERE time {IN_RANGE})"""
)
def overall_completeness(spark, sf_dir):
    return quality.overall_completeness(observations(spark, sf_dir), *RANGE)


@query(
    with_views("observations")
    + f"SELECT count(rsl) AS valid_count, count(*) - count(rsl) AS null_count, count(*) AS total_records FROM observations WHERE time {IN_RANGE}"
)
def quality_counts(spark, sf_dir):
    return quality.quality_counts(observations(spark, sf_dir), *RANGE)


_ACTIVE = f"""SELECT bucket, count(*) AS n FROM (SELECT DISTINCT date_trunc('hour', time) AS bucket, user_id, cml_id, sublink_id FROM observations)
    WHERE bucket {IN_RANGE} GROUP BY bucket"""


@query(with_views("observations") + f"SELECT bucket, n AS sublinks FROM ({_ACTIVE})")
def active_sublinks_hourly(spark, sf_dir):
    return rollup.active_sublinks(rollup.hourly_rollup(observations(spark, sf_dir)), *RANGE)


@query(with_views("observations") + f"SELECT bucket, n * 360 AS data_points FROM ({_ACTIVE})")
def approx_points_hourly(spark, sf_dir):
    return rollup.approximate_points(rollup.hourly_rollup(observations(spark, sf_dir)), *RANGE)


@query(
    with_views("observations", "links")
    + """SELECT user_id, total_links, CAST(total_records AS BIGINT) AS total_records, first_bucket, last_bucket,
    CAST(floor(date_diff('second', first_bucket, last_bucket) / 86400) AS BIGINT) AS days
    FROM (SELECT user_id, count(DISTINCT cml_id) AS total_links FROM links GROUP BY 1)
    FULL JOIN (SELECT user_id, count(*) AS total_records, date_trunc('hour', min(time)) AS first_bucket,
    date_trunc('hour', max(time)) AS last_bucket FROM observations GROUP BY 1) USING (user_id)"""
)
def overview(spark, sf_dir):
    """Per tenant: links, records, first and last bucket, days between."""
    obs = observations(spark, sf_dir)
    buckets = obs.select("user_id", F.window("time", "1 hour")["start"].alias("bucket"))
    counted = L.link_count(links(spark, sf_dir), ["user_id"])
    records = L.total_records(stats.lifetime_stats(obs), ["user_id"])
    spans = rollup.time_range(buckets, ["user_id"])
    joined = counted.join(records, "user_id", "full_outer").join(spans, "user_id", "full_outer")
    return joined.withColumn("days", whole_days(F.col("first_bucket"), F.col("last_bucket")))


@query(
    with_views("observations")
    + """SELECT strftime(date_trunc('hour', min(time)), '%Y-%m-%dT%H:%M:%S') AS earliest,
    strftime(date_trunc('hour', max(time)), '%Y-%m-%dT%H:%M:%S') AS latest FROM observations"""
)
def data_time_range(spark, sf_dir):
    buckets = observations(spark, sf_dir).select(F.window("time", "1 hour")["start"].alias("bucket"))
    span = rollup.time_range(buckets)
    return span.select(rollup.iso_text(F.col("first_bucket")).alias("earliest"), rollup.iso_text(F.col("last_bucket")).alias("latest"))


@query(
    with_views("observations")
    + f"SELECT * FROM observations WHERE time {IN_RANGE} AND cml_id ILIKE '%1%' ORDER BY time DESC, user_id, cml_id, sublink_id LIMIT 5000"
)
def raw_newest(spark, sf_dir):
    return raw.newest_rows(observations(spark, sf_dir), *RANGE, search="1")


@query(with_views("observations") + "SELECT min(time) AS start_time, max(time) AS end_time, count(*) AS total_rows FROM observations")
def load_summary(spark, sf_dir):
    return raw.load_summary(observations(spark, sf_dir))


@query(with_views("observations") + "SELECT max(time) AS latest FROM observations")
def freshness(spark, sf_dir):
    return raw.freshness(observations(spark, sf_dir))


_PADDED = "SELECT * REPLACE (CASE WHEN sublink_id <> 'error' THEN rsl END AS rsl) FROM observations"


@query(
    with_views("observations", extra={"padded": _PADDED})
    + "SELECT * FROM padded WHERE sublink_id IN (SELECT sublink_id FROM padded GROUP BY 1 HAVING count(rsl) > 0)"
)
def active_sublinks_filter(spark, sf_dir):
    """One sublink is padding without any value and is dropped."""
    obs = observations(spark, sf_dir)
    padded = obs.withColumn("rsl", F.when(F.col("sublink_id") != "error", F.col("rsl")))
    return raw.keep_active_sublinks(padded, padded)
