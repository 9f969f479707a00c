"""Registered queries: links, file log, tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from fadeline.functions.geo import haversine_m
from fadeline.functions.numbers import half_up
from fadeline.operators import links as L
from fadeline.operators import pipeline_log as P
from fadeline.operators import tenancy
from fadeline.plans.catalog import half_up_sql as R
from fadeline.plans.catalog import query, with_views
from fadeline.plans.queries_stats import STATS_CTE, windowed_stats
from fadeline.plans.views import LOG_AS_OF, TENANTS, file_log, links, observations
from fadeline.schemas import COORDINATES

_ONE = """one AS (SELECT user_id, cml_id, arg_min(site_0_lon, sublink_id) AS site_0_lon, arg_min(site_0_lat, sublink_id) AS site_0_lat,
    arg_min(site_1_lon, sublink_id) AS site_1_lon, arg_min(site_1_lat, sublink_id) AS site_1_lat FROM links GROUP BY user_id, cml_id)"""


@query(with_views("links") + f", {_ONE} SELECT * FROM one")
def link_representatives(spark, sf_dir):
    return L.one_per_link(links(spark, sf_dir))


@query(
    with_views("links")
    + f", {_ONE} SELECT user_id, cml_id, site_0_lon AS lon_0, site_0_lat AS lat_0, site_1_lon AS lon_1, site_1_lat AS lat_1 FROM one"
)
def link_map(spark, sf_dir):
    nested = L.link_map(links(spark, sf_dir))
    ends = [F.col(f"site_{i}.{axis}").alias(f"{axis}_{i}") for i in (0, 1) for axis in ("lon", "lat")]
    return nested.select("user_id", "cml_id", *ends)


@query(
    with_views("links")
    + f""", {_ONE} SELECT user_id, cml_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[' || CAST(site_0_lon AS VARCHAR) || ',' ||
    CAST(site_0_lat AS VARCHAR) || '],[' || CAST(site_1_lon AS VARCHAR) || ',' || CAST(site_1_lat AS VARCHAR) || ']]}},"properties":{{"cml_id":"' ||
    cml_id || '"}}}}' AS feature FROM one"""
)
def link_geojson(spark, sf_dir):
    return L.link_features(links(spark, sf_dir))


@query(with_views("links") + "SELECT DISTINCT cml_id FROM links")
def link_ids(spark, sf_dir):
    return L.link_ids(links(spark, sf_dir))


@query(with_views("links") + "SELECT min(cml_id) AS cml_id FROM links")
def default_link(spark, sf_dir):
    return L.default_link(links(spark, sf_dir))


@query(with_views("links") + "SELECT count(DISTINCT cml_id) AS total_links FROM links")
def link_count(spark, sf_dir):
    return L.link_count(links(spark, sf_dir))


@query(
    with_views("links")
    + f""", {_ONE} SELECT count(*) AS links, {R('avg(site_0_lon)', 6)} AS mean_lon, {R('avg(site_0_lat)', 6)} AS mean_lat,
    min(least(site_0_lon, site_1_lon)) AS min_lon, min(least(site_0_lat, site_1_lat)) AS min_lat,
    max(greatest(site_0_lon, site_1_lon)) AS max_lon, max(greatest(site_0_lat, site_1_lat)) AS max_lat,
    CASE WHEN count(*) = 1 THEN min((site_0_lon + site_1_lon) / 2) END AS midpoint_lon,
    CASE WHEN count(*) = 1 THEN min((site_0_lat + site_1_lat) / 2) END AS midpoint_lat FROM one"""
)
def network_extent(spark, sf_dir):
    extent = L.network_extent(links(spark, sf_dir))
    return extent.withColumns({c: half_up(F.col(c), 6) for c in ("mean_lon", "mean_lat")})


_HAVERSINE = """2 * 6371000e0 * asin(sqrt(pow(sin(radians(site_1_lat - site_0_lat) / 2), 2) +
    cos(radians(site_0_lat)) * cos(radians(site_1_lat)) * pow(sin(radians(site_1_lon - site_0_lon) / 2), 2)))"""


@query(with_views("links") + f"SELECT cml_id, sublink_id, {R(_HAVERSINE, 3)} AS length FROM links")
def haversine_length(spark, sf_dir):
    distance = half_up(haversine_m(*[F.col(c) for c in COORDINATES]), 3)
    return links(spark, sf_dir).select("cml_id", "sublink_id", distance.alias("length"))


@query(
    with_views("links")
    + f"""SELECT l.cml_id, l.sublink_id, l.frequency, p.polarization FROM links l LEFT JOIN
    (SELECT cml_id, sublink_id, polarization FROM links WHERE sublink_id <> 'view') p USING (cml_id, sublink_id)"""
)
def polarization_join(spark, sf_dir):
    """Attach an attribute that some sublinks lack."""
    rows = links(spark, sf_dir)
    known = rows.where("sublink_id <> 'view'").select("cml_id", "sublink_id", "polarization")
    return L.attach_attribute(rows.select("cml_id", "sublink_id", "frequency"), known)


def _observed_stats(spark, sf_dir):
    """Statistics of links that sent in the last six hours: the others have no row."""
    return windowed_stats(spark, sf_dir).where("last_rsl IS NOT NULL OR total_records_6h > 0")


_JOINED = (
    STATS_CTE
    + """, st AS (SELECT windowed.*, last_rsl FROM windowed LEFT JOIN last USING (user_id, cml_id)
    WHERE last_rsl IS NOT NULL OR total_records_6h > 0),
    j AS (SELECT l.user_id, l.cml_id, st.* EXCLUDE (user_id, cml_id), st.cml_id IS NOT NULL AS has
    FROM (SELECT DISTINCT user_id, cml_id FROM links) l LEFT JOIN st USING (user_id, cml_id))"""
)


@query(
    _JOINED
    + """SELECT user_id, cml_id,
    CASE WHEN NOT has THEN 'blue' WHEN coalesce(completeness_percent_6h, 0) >= 90 THEN 'green' WHEN coalesce(completeness_percent_6h, 0) >= 70 THEN 'yellow'
      WHEN coalesce(completeness_percent_6h, 0) >= 50 THEN 'orange' ELSE 'red' END AS completeness_band,
    CASE WHEN NOT has THEN 'blue' WHEN last_rsl IS NULL THEN 'grey' WHEN last_rsl >= -40 THEN 'green' WHEN last_rsl >= -45 THEN 'yellow'
      WHEN last_rsl >= -50 THEN 'orange' ELSE 'red' END AS signal_band,
    CASE WHEN NOT has THEN 'blue' WHEN stddev_rsl_1h IS NULL THEN 'grey' WHEN stddev_rsl_1h <= 1 THEN 'green' WHEN stddev_rsl_1h <= 2 THEN 'yellow'
      WHEN stddev_rsl_1h <= 3 THEN 'orange' ELSE 'red' END AS stability_band FROM j"""
)
def link_bands(spark, sf_dir):
    return L.link_bands(links(spark, sf_dir), _observed_stats(spark, sf_dir))


def _plain(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


@query(
    _JOINED
    + f"""SELECT user_id, cml_id, concat_ws(chr(10), 'CML ' || cml_id,
    CASE WHEN has THEN 'Completeness (6h): ' || coalesce({_plain('completeness_percent_6h')}, 'null') || '%' END,
    CASE WHEN has THEN 'Valid records (6h): ' || valid_records_6h || '/' || total_records_6h END,
    CASE WHEN has THEN 'Last RSL: ' || {_plain('last_rsl')} || ' dBm' END,
    CASE WHEN has THEN 'Std Dev (1h): ' || {_plain('stddev_rsl_1h')} END) AS summary FROM j"""
)
def link_summary(spark, sf_dir):
    return L.link_summaries(links(spark, sf_dir), _observed_stats(spark, sf_dir))


@query(with_views("links") + "SELECT * FROM links WHERE cml_id ILIKE '%12%'")
def metadata_search(spark, sf_dir):
    return L.search_links(links(spark, sf_dir), "12")


@query(
    with_views("file_log")
    + f"""SELECT *, {R('100e0 * archived / nullif(archived + quarantined, 0)', 1)} AS success_rate FROM (SELECT
    count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'quarantined') AS quarantined,
    CAST(coalesce(sum(rows_written) FILTER (WHERE status = 'archived'), 0) AS BIGINT) AS total_rows_written FROM file_log)"""
)
def log_totals(spark, sf_dir):
    return P.log_totals(file_log(spark, sf_dir))


_LOG_NOW = f"TIMESTAMP '{LOG_AS_OF}'"


@query(
    with_views("file_log")
    + f"""SELECT *, CASE WHEN quarantined >= 1 THEN 'red' ELSE 'green' END AS alarm FROM (SELECT
    count(*) FILTER (WHERE status = 'quarantined') AS quarantined, count(*) FILTER (WHERE status = 'archived') AS archived,
    CAST(coalesce(sum(rows_written) FILTER (WHERE status = 'archived'), 0) AS BIGINT) AS rows_written
    FROM file_log WHERE processed_at >= {_LOG_NOW} - INTERVAL 24 HOUR)"""
)
def log_last_24h(spark, sf_dir):
    return P.log_last_day(file_log(spark, sf_dir), LOG_AS_OF)


@query(
    with_views("file_log")
    + f"""SELECT user_id, archived, quarantined, total, {R('100e0 * archived / nullif(total, 0)', 1)} AS success_rate_pct, rows_written, last_activity,
    CASE WHEN quarantined >= 5 THEN 'red' WHEN quarantined >= 1 THEN 'yellow' ELSE 'green' END AS quarantine_band
    FROM (SELECT user_id, count(*) FILTER (WHERE status = 'archived') AS archived, count(*) FILTER (WHERE status = 'quarantined') AS quarantined,
    count(*) AS total, CAST(coalesce(sum(rows_written) FILTER (WHERE status = 'archived'), 0) AS BIGINT) AS rows_written,
    max(processed_at) AS last_activity FROM file_log WHERE processed_at >= {_LOG_NOW} - INTERVAL 7 DAY GROUP BY user_id)"""
)
def log_user_7d(spark, sf_dir):
    return P.log_by_user(file_log(spark, sf_dir), LOG_AS_OF)


_LOG_RANGE = ("1995-01-01 00:00:00", "2001-06-30 12:00:00")
_IN_LOG = f"processed_at BETWEEN TIMESTAMP '{_LOG_RANGE[0]}' AND TIMESTAMP '{_LOG_RANGE[1]}'"


def _hourly_sql(value: str, status: str) -> str:
    return f"SELECT date_trunc('hour', processed_at) AS time, user_id, {value} FROM file_log WHERE {_IN_LOG} AND status = '{status}' GROUP BY 1, 2"


@query(with_views("file_log") + _hourly_sql("count(*) AS archived", "archived"))
def log_hourly_archived(spark, sf_dir):
    return P.hourly_archived(file_log(spark, sf_dir), *_LOG_RANGE)


@query(with_views("file_log") + _hourly_sql("count(*) AS quarantined", "quarantined"))
def log_hourly_quarantined(spark, sf_dir):
    return P.hourly_quarantined(file_log(spark, sf_dir), *_LOG_RANGE)


@query(with_views("file_log") + _hourly_sql("CAST(coalesce(sum(rows_written), 0) AS BIGINT) AS rows_written", "archived"))
def log_hourly_rows(spark, sf_dir):
    return P.hourly_rows(file_log(spark, sf_dir), *_LOG_RANGE)


_SHOWN = """id, user_id, filename, status, rows_written, CASE WHEN length(error_message) > 80 THEN left(error_message, 80) || '…'
    ELSE error_message END AS error_message, processed_at"""


@query(
    with_views("file_log")
    + f"SELECT {_SHOWN} FROM file_log WHERE status = 'quarantined' AND filename ILIKE '%DATA%' ORDER BY processed_at DESC, id DESC LIMIT 50 OFFSET 50"
)
def log_page(spark, sf_dir):
    return P.log_page(file_log(spark, sf_dir), page="2", status="quarantined", search=" DATA ")


@query(
    with_views("file_log")
    + f"""SELECT {_SHOWN} FROM file_log WHERE processed_at < TIMESTAMP '1998-06-01 12:00:00'
    OR (processed_at = TIMESTAMP '1998-06-01 12:00:00' AND id < 100) ORDER BY processed_at DESC, id DESC LIMIT 50"""
)
def log_page_after(spark, sf_dir):
    return P.log_page_after(file_log(spark, sf_dir), "1998-06-01 12:00:00", 100, status="all")


@query(
    with_views("file_log")
    + """SELECT total, greatest(1, CAST(ceil(total / 50e0) AS BIGINT)) AS total_pages, CAST(1 AS BIGINT) AS first_page_shown,
    least(greatest(1, CAST(ceil(total / 50e0) AS BIGINT)), 5) AS last_page_shown
    FROM (SELECT count(*) AS total FROM file_log WHERE filename ILIKE '%meta%')"""
)
def log_page_info(spark, sf_dir):
    return P.log_page_info(file_log(spark, sf_dir), page=3, search="meta")


@query(
    with_views("file_log")
    + f"""SELECT processed_at, user_id, filename, error_message FROM file_log WHERE {_IN_LOG} AND status = 'quarantined'
    ORDER BY processed_at DESC, id DESC LIMIT 200"""
)
def quarantine_recent(spark, sf_dir):
    return P.recent_quarantined(file_log(spark, sf_dir), *_LOG_RANGE)


@query(with_views("observations") + "SELECT * FROM observations WHERE user_id = 'tenant_b'")
def tenant_scope(spark, sf_dir):
    return tenancy.TenantScope("tenant_b", TENANTS).table(observations(spark, sf_dir))


@query(with_views("observations") + "SELECT user_id, count(*) AS rows FROM observations GROUP BY 1")
def admin_scope(spark, sf_dir):
    seen = tenancy.AdminScope().table(observations(spark, sf_dir))
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    with_views("file_log")
    + """SELECT id, user_id, coalesce(user_id = 'tenant_a', false) AS accepted,
    CASE WHEN user_id = 'tenant_a' THEN NULL ELSE 'row belongs to ' || user_id END AS reason FROM file_log"""
)
def tenant_write_check(spark, sf_dir):
    scope = tenancy.TenantScope("tenant_a", TENANTS)
    return scope.check_write(file_log(spark, sf_dir).select("id", "user_id"))


@query(
    with_views("file_log")
    + """SELECT id, CASE WHEN status = 'quarantined' THEN 'default' WHEN user_id = 'tenant_b' THEN 'tenant_renamed' ELSE user_id END AS user_id FROM file_log"""
)
def tenant_relabel(spark, sf_dir):
    log = file_log(spark, sf_dir)
    gaps = log.select("id", F.when(F.col("status") != "quarantined", F.col("user_id")).alias("user_id"))
    return tenancy.relabel_tenants(gaps, {"tenant_b": "tenant_renamed"})
