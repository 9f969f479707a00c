"""Table functions for SQL users: statistics of a tenant's links, and of the last hours.

They are temporary functions over two views, so Spark plans them like any query:
filters on tenant, day and link reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBSERVATIONS, LINKS = "link_observations", "known_links"


def _rounded(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), 2) AS DOUBLE)"


def _window(hours: int) -> str:
    return f"FILTER (WHERE o.in_{hours}h)"


def _completeness(hours: int) -> str:
    f = _window(hours)
    return _rounded(f"100D * count(o.rsl) {f} / nullif(count(o.time) {f}, 0)")


LIFETIME = f"""
CREATE OR REPLACE TEMPORARY FUNCTION lifetime_statistics(tenant STRING)
RETURNS TABLE (user_id STRING, cml_id STRING, total_records BIGINT, valid_records BIGINT, null_records BIGINT,
  completeness_percent DOUBLE, min_rsl DOUBLE, max_rsl DOUBLE, mean_rsl DOUBLE, stddev_rsl DOUBLE, last_rsl DOUBLE)
RETURN SELECT user_id, cml_id, count(*), count(rsl), count(*) - count(rsl), {_rounded('100D * count(rsl) / count(*)')},
  CAST(min(rsl) AS DOUBLE), CAST(max(rsl) AS DOUBLE), {_rounded('avg(CAST(rsl AS DOUBLE))')},
  {_rounded('CASE WHEN count(rsl) > 1 THEN stddev_samp(CAST(rsl AS DOUBLE)) END')}, CAST(max_by(rsl, struct(time, sublink_id)) AS DOUBLE)
FROM {OBSERVATIONS} WHERE user_id = lifetime_statistics.tenant GROUP BY user_id, cml_id
"""

WINDOWED = f"""
CREATE OR REPLACE TEMPORARY FUNCTION windowed_statistics(as_of TIMESTAMP_NTZ)
RETURNS TABLE (user_id STRING, cml_id STRING, completeness_percent_6h DOUBLE, total_records_6h BIGINT, valid_records_6h BIGINT,
  mean_rsl_6h DOUBLE, stddev_rsl_6h DOUBLE, completeness_percent_1h DOUBLE, mean_rsl_1h DOUBLE, stddev_rsl_1h DOUBLE)
RETURN SELECT l.user_id, l.cml_id, {_completeness(6)}, count(o.time) {_window(6)}, count(o.rsl) {_window(6)},
  {_rounded(f'avg(CAST(o.rsl AS DOUBLE)) {_window(6)}')}, {_rounded(f'CASE WHEN count(o.rsl) {_window(6)} > 1 THEN stddev_samp(CAST(o.rsl AS DOUBLE)) {_window(6)} END')},
  {_completeness(1)}, {_rounded(f'avg(CAST(o.rsl AS DOUBLE)) {_window(1)}')}, {_rounded(f'CASE WHEN count(o.rsl) {_window(1)} > 1 THEN stddev_samp(CAST(o.rsl AS DOUBLE)) {_window(1)} END')}
FROM (SELECT DISTINCT user_id, cml_id FROM {LINKS}) l
LEFT JOIN (
  SELECT user_id, cml_id, time, rsl, true AS in_6h, time >= windowed_statistics.as_of - INTERVAL 1 HOUR AS in_1h
  FROM {OBSERVATIONS} WHERE time >= windowed_statistics.as_of - INTERVAL 6 HOURS
) o ON o.user_id = l.user_id AND o.cml_id = l.cml_id
GROUP BY l.user_id, l.cml_id
"""


def register(spark: SparkSession, observations: DataFrame, links: DataFrame) -> None:
    """Makes ``lifetime_statistics(tenant)`` and ``windowed_statistics(as_of)`` known to
    the session, over these frames."""
    observations.createOrReplaceTempView(OBSERVATIONS)
    links.createOrReplaceTempView(LINKS)
    for statement in (LIFETIME, WINDOWED):
        spark.sql(statement)
