"""Registered queries: upserts, validation, series, incremental loading."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.functions.text import landed_name, window_text
from fadeline.functions.times import moment
from fadeline.operators import increments as I
from fadeline.operators import rollup, series, upsert, validate
from fadeline.plans.catalog import query, with_views
from fadeline.plans.queries_stats import AS_OF, rounded, rollup_sql
from fadeline.plans.views import arrivals, file_log, links, observations, table

KEY = "time, cml_id, sublink_id, user_id"
FIRST = f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seq) AS rn FROM arrivals) WHERE rn = 1"""


@query(with_views("arrivals") + FIRST)
def first_wins(spark, sf_dir):
    return upsert.first_wins(arrivals(spark, sf_dir))


@query(
    with_views("arrivals")
    + f"""SELECT {KEY}, min(seq) AS seq, arg_min(rsl, seq) FILTER (WHERE rsl IS NOT NULL) AS rsl,
    arg_min(tsl, seq) FILTER (WHERE tsl IS NOT NULL) AS tsl FROM arrivals GROUP BY {KEY}"""
)
def fill_nulls(spark, sf_dir):
    return upsert.fill_nulls(arrivals(spark, sf_dir))


@query(
    with_views("arrivals", extra={"stored": "SELECT * FROM observations WHERE tsl < 95", "first": FIRST})
    + f"SELECT * FROM first WHERE ({KEY}) NOT IN (SELECT ({KEY}) FROM stored)"
)
def append_new_rows(spark, sf_dir):
    """What a batch adds to a table that already has most of its keys."""
    stored = observations(spark, sf_dir).where("tsl < 95")
    return upsert.new_rows(stored, arrivals(spark, sf_dir))


def _revised(spark, sf_dir) -> DataFrame:
    """A later metadata delivery: two versions of each link of half the customers."""
    rows = links(spark, sf_dir).where("polarization = 'H'")
    version = F.explode(F.array(F.lit(1), F.lit(2)))
    return rows.withColumn("seq", version).withColumn("frequency", F.col("frequency") + F.col("seq"))


_LINK_COLUMNS = "cml_id, sublink_id, user_id, site_0_lon, site_0_lat, site_1_lon, site_1_lat, frequency, polarization"


@query(
    with_views("links")
    + "SELECT * REPLACE (CASE WHEN polarization = 'H' THEN frequency + 2 ELSE frequency END AS frequency) FROM links"
)
def metadata_upsert(spark, sf_dir):
    return upsert.merge_last_wins(links(spark, sf_dir), _revised(spark, sf_dir))


@query(
    with_views("links")
    + """SELECT * REPLACE (CASE WHEN sublink_id IN ('click', 'view') THEN frequency ELSE frequency + 2 END AS frequency) FROM links
    WHERE sublink_id IN ('click', 'view') OR polarization = 'H'"""
)
def metadata_insert_new(spark, sf_dir):
    """Two sublinks are stored; the delivery has all five but adds three only."""
    stored = links(spark, sf_dir).where(F.col("sublink_id").isin("click", "view"))
    return upsert.insert_if_absent(stored, _revised(spark, sf_dir).where("seq = 2").drop("seq"))


@query(with_views("arrivals") + f"SELECT {KEY}, count(*) AS copies FROM arrivals GROUP BY {KEY} HAVING count(*) > 1")
def key_audit(spark, sf_dir):
    return upsert.repeated_keys(arrivals(spark, sf_dir))


@query(
    with_views("observations", "links")
    + """SELECT DISTINCT user_id, cml_id, sublink_id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM links l
    WHERE l.user_id = o.user_id AND l.cml_id = o.cml_id AND l.sublink_id = o.sublink_id)"""
)
def missing_references(spark, sf_dir):
    return validate.missing_references(observations(spark, sf_dir), links(spark, sf_dir))


@query(
    with_views("observations", "links")
    + """, m AS (SELECT DISTINCT user_id, cml_id, sublink_id FROM observations EXCEPT SELECT user_id, cml_id, sublink_id FROM links)
    SELECT *, (SELECT count(*) FROM m) AS missing_pairs FROM m ORDER BY user_id, cml_id, sublink_id LIMIT 10"""
)
def missing_reference_warning(spark, sf_dir):
    return validate.missing_reference_warning(observations(spark, sf_dir), links(spark, sf_dir))


_ORPHANS = """SELECT count(*) AS orphans FROM observations o WHERE NOT EXISTS (SELECT 1 FROM links l
    WHERE l.cml_id = o.cml_id AND l.sublink_id = o.sublink_id)"""


@query(with_views("observations", "links") + _ORPHANS)
def orphan_count(spark, sf_dir):
    return validate.orphan_count(observations(spark, sf_dir), links(spark, sf_dir))


@query(
    with_views("observations", "links")
    + """SELECT count(*) AS orphans FROM observations o LEFT JOIN (SELECT DISTINCT cml_id, sublink_id FROM links) l
    ON l.cml_id = o.cml_id AND l.sublink_id = o.sublink_id WHERE l.cml_id IS NULL"""
)
def orphan_count_left_join(spark, sf_dir):
    return validate.orphan_count_left_join(observations(spark, sf_dir), links(spark, sf_dir))


_SITES = """SELECT 'meta_' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '.csv' AS filename,
    CASE WHEN c_nationkey % 4 <> 1 THEN c_acctbal / 52 END AS site_0_lon, c_acctbal / 112 AS site_0_lat,
    CASE WHEN c_nationkey % 5 <> 2 OR c_acctbal > 0 THEN c_acctbal / 60 END AS site_1_lon, c_acctbal / 120 AS site_1_lat FROM customer"""


def _metadata_files(spark, sf_dir) -> DataFrame:
    """Metadata files by nation; some hold wrong or missing coordinates."""
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("meta_"), F.lpad(nation.cast("string"), 2, "0"), F.lit(".csv")).alias("filename"),
        F.when(nation % 4 != 1, balance / 52).alias("site_0_lon"),
        (balance / 112).alias("site_0_lat"),
        F.when((nation % 5 != 2) | (balance > 0), balance / 60).alias("site_1_lon"),
        (balance / 120).alias("site_1_lat"),
    )


def _range_sql(column: str, low: int, high: int) -> str:
    return f"(count({column}) = 0 OR bool_and(coalesce({column} BETWEEN {low} AND {high}, false)))"


@query(
    f"""WITH sites AS ({_SITES}) SELECT filename, reason IS NULL AS valid, reason FROM (SELECT filename, CASE
    WHEN NOT {_range_sql('site_0_lon', -180, 180)} THEN 'site_0_lon out of range or incomplete'
    WHEN NOT {_range_sql('site_1_lon', -180, 180)} THEN 'site_1_lon out of range or incomplete'
    WHEN NOT {_range_sql('site_0_lat', -90, 90)} THEN 'site_0_lat out of range or incomplete'
    WHEN NOT {_range_sql('site_1_lat', -90, 90)} THEN 'site_1_lat out of range or incomplete' END AS reason FROM sites GROUP BY filename)"""
)
def coordinate_check(spark, sf_dir):
    return validate.coordinate_check(_metadata_files(spark, sf_dir))


def _raw_files(spark, sf_dir) -> DataFrame:
    """Observations as files per day and sublink; very strong levels stand for
    rows whose time could not be read."""
    rows = observations(spark, sf_dir)
    name = F.concat(F.lit("cml_data_"), F.date_format("time", "yyyyMMdd"), F.lit("_"), F.col("sublink_id"), F.lit(".csv"))
    readable = F.when(F.coalesce(F.col("rsl") > -250, F.lit(True)), F.col("time"))
    return rows.withColumn("filename", name).withColumn("time", readable)


_RAW_FILES = """SELECT 'cml_data_' || strftime(time, '%Y%m%d') || '_' || sublink_id || '.csv' AS filename, * REPLACE
    (CASE WHEN coalesce(rsl > -250, true) THEN time END AS time) FROM observations"""
_VERDICT = """SELECT filename, user_id, count(*) AS rows_read, count(*) FILTER (WHERE time IS NULL) AS null_times,
    CASE WHEN bool_or(time IS NULL) THEN 'quarantined' ELSE 'archived' END AS status,
    CASE WHEN bool_or(time IS NULL) THEN 'time is null' END AS reason FROM raw_files GROUP BY filename, user_id"""


@query(
    with_views("observations", extra={"raw_files": _RAW_FILES, "verdict": _VERDICT})
    + """SELECT * FROM verdict UNION ALL SELECT filename, user_id, 0, 0, 'quarantined', 'Empty file' FROM (SELECT DISTINCT filename || '.part' AS filename, user_id FROM raw_files)"""
)
def file_verdict(spark, sf_dir):
    """Verdict per file.  Each file has an empty companion in the listing."""
    rows = _raw_files(spark, sf_dir)
    names = rows.select("filename", "user_id").distinct()
    empty = names.withColumn("filename", F.concat("filename", F.lit(".part")))
    return validate.file_verdicts(rows, names.unionByName(empty), ["filename", "user_id"])


@query(
    with_views("observations", extra={"raw_files": _RAW_FILES, "verdict": _VERDICT})
    + """SELECT user_id, filename, status, CASE WHEN status = 'archived' THEN rows_read END AS rows_written, reason AS error_message FROM verdict"""
)
def audit_rows(spark, sf_dir):
    """One log row per file outcome."""
    rows = _raw_files(spark, sf_dir)
    verdicts = validate.file_verdicts(rows, rows.select("filename", "user_id").distinct(), ["filename", "user_id"])
    written = F.when(F.col("status") == "archived", F.col("rows_read"))
    return verdicts.select("user_id", "filename", "status", written.alias("rows_written"), F.col("reason").alias("error_message"))


@query(with_views("observations", extra={"raw_files": _RAW_FILES}) + "SELECT filename, count(*) AS rows FROM raw_files GROUP BY 1")
def rows_per_file(spark, sf_dir):
    return _raw_files(spark, sf_dir).groupBy("filename").agg(F.count(F.lit(1)).alias("rows"))


@query(
    with_views("file_log")
    + """SELECT id, CASE WHEN id % 3 = 0 THEN 'filename' WHEN status = 'quarantined' THEN 'rows_written' END AS broken FROM file_log
    WHERE id % 3 = 0 OR status = 'quarantined'"""
)
def constraint_check(spark, sf_dir):
    """Rows that break a NOT NULL or CHECK constraint, with the column."""
    log = file_log(spark, sf_dir)
    gaps = log.withColumn("filename", F.when(F.col("id") % 3 != 0, F.col("filename")))
    broken = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("filename", "rows_written")],
        F.when(~validate.status_valid(F.col("status")), F.lit("status")),
    )
    return gaps.select("id", broken.alias("broken")).where("broken IS NOT NULL")


@query(
    with_views("observations")
    + "SELECT * REPLACE (TIMESTAMP '2024-06-01 00:00:00' - ((SELECT max(time) FROM observations) - time) AS time) FROM observations"
)
def time_shift(spark, sf_dir):
    return series.shift_to_end(observations(spark, sf_dir), "2024-06-01 00:00:00")


@query(with_views("observations") + "SELECT * FROM observations WHERE time > (SELECT max(time) FROM observations) - INTERVAL 7 DAY")
def last_days(spark, sf_dir):
    return series.last_days(observations(spark, sf_dir), 7)


@query(
    with_views("observations")
    + """SELECT * FROM observations WHERE time >= (SELECT min(time) FROM (SELECT DISTINCT time FROM observations ORDER BY time DESC LIMIT 720))"""
)
def last_steps(spark, sf_dir):
    return series.last_steps(observations(spark, sf_dir), 720)


@query(
    with_views("observations", extra={"hourly": rollup_sql()})
    + """, b AS (SELECT min(bucket) AS t0, date_diff('second', min(bucket), max(bucket)) AS span FROM hourly),
    grid AS (SELECT TIMESTAMP '2024-03-01 00:00:00' + INTERVAL 1 SECOND * (i * 1800) AS time, ((i * 1800) % (20 * 86400)) % span // 3600 AS step_no
    FROM (SELECT unnest(range(0, 25 * 48 + 1)) AS i), b)
    SELECT grid.time, user_id, cml_id, sublink_id, rsl_avg AS rsl, tsl_avg AS tsl
    FROM grid JOIN (SELECT *, date_diff('second', t0, bucket) // 3600 AS step_no FROM hourly, b) USING (step_no)"""
)
def replay_grid(spark, sf_dir):
    """The hourly series on a half-hour grid of 25 days, in a loop of 20 days."""
    hourly = rounded(rollup.hourly_rollup(observations(spark, sf_dir))).select(
        F.col("bucket").alias("time"), "user_id", "cml_id", "sublink_id", F.col("rsl_avg").alias("rsl"), F.col("tsl_avg").alias("tsl")
    )
    return series.replay(
        hourly, "2024-03-01", "2024-03-26", timedelta(minutes=30), loop=timedelta(days=20), step=timedelta(hours=1)
    )


@query(
    with_views("observations")
    + """SELECT 'cml_data_' || strftime(time_bucket(INTERVAL 6 HOUR, time, TIMESTAMP '1970-01-01'), '%Y%m%d_%H%M%S') || '.csv' AS period_file, count(*) AS rows
    FROM observations GROUP BY 1"""
)
def split_periods(spark, sf_dir):
    rows = observations(spark, sf_dir).select(series.period_file("time", "6 hours").alias("period_file"))
    return rows.groupBy("period_file").agg(F.count(F.lit(1)).alias("rows"))


_INVENTORY = "SELECT user_id AS source, filename, CASE WHEN id % 5 = 0 THEN processed_at + INTERVAL 1 DAY ELSE processed_at END AS mtime FROM file_log"


@query(
    with_views("file_log", extra={"inventory": _INVENTORY})
    + """SELECT source, filename, mtime FROM inventory WHERE (source, filename, mtime) NOT IN
    (SELECT (user_id, filename, processed_at) FROM file_log WHERE status = 'archived')"""
)
def unseen_files(spark, sf_dir):
    """New, changed and failed files against the ledger of archived ones."""
    log = file_log(spark, sf_dir)
    touched = F.when(F.col("id") % 5 == 0, F.col("processed_at") + F.make_dt_interval(days=F.lit(1))).otherwise(F.col("processed_at"))
    inventory = log.select(F.col("user_id").alias("source"), "filename", touched.alias("mtime"))
    ledger = log.where("status = 'archived'").select(
        F.col("user_id").alias("source"), "filename", F.col("processed_at").alias("mtime"), F.col("processed_at").alias("seen_at")
    )
    return I.unseen_files(inventory, ledger)


def _sources(spark, sf_dir) -> DataFrame:
    """Each link as a source with the span of its observations."""
    rows = observations(spark, sf_dir)
    return rows.groupBy(F.col("cml_id").alias("source")).agg(
        F.date_trunc("hour", F.min("time")).cast("timestamp_ntz").alias("backfill_start"),
        F.max("time").alias("backfill_end"),
    )


_PLAN = """SELECT cml_id AS source, w AS window_start, least(w + INTERVAL 24 HOUR, e) AS window_end FROM (SELECT cml_id, e,
    unnest(generate_series(b, e, INTERVAL 24 HOUR)) AS w FROM (SELECT cml_id, date_trunc('hour', min(time)) AS b, max(time) AS e
    FROM observations GROUP BY cml_id)) WHERE w < e"""


@query(with_views("observations") + _PLAN)
def plan_backfill(spark, sf_dir):
    return I.backfill_windows(_sources(spark, sf_dir), 24)


@query(
    with_views("observations")
    + f"""SELECT cml_id AS source, c - INTERVAL 600 SECOND AS window_start, least(c + INTERVAL 6 HOUR, {AS_OF} - INTERVAL 2 DAY) AS window_end
    FROM (SELECT cml_id, max(time) AS c FROM observations GROUP BY cml_id) WHERE least(c + INTERVAL 6 HOUR, {AS_OF} - INTERVAL 2 DAY) > c - INTERVAL 600 SECOND"""
)
def plan_continuous(spark, sf_dir):
    rows = observations(spark, sf_dir)
    known = rows.groupBy(F.col("cml_id").alias("source")).agg(F.max("time").alias("cursor"))
    return I.continuous_window(known, "2024-01-29 00:00:00", chunk_hours=6, overlap_seconds=600)


_LEDGER = """SELECT source, window_start, variant, CASE WHEN variant = 'tsl' AND day(window_start) % 4 = 0 THEN 'failed' ELSE 'done' END AS status
    FROM planned WHERE window_start < TIMESTAMP '2024-01-25 00:00:00'"""


@query(
    with_views("observations", extra={"plan": _PLAN, "planned": "SELECT *, unnest(['rsl', 'tsl']) AS variant FROM plan", "ledger": _LEDGER})
    + """SELECT * FROM planned p WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.source = p.source AND l.window_start = p.window_start
    AND l.variant = p.variant AND l.status IN ('done', 'empty'))"""
)
def window_ledger(spark, sf_dir):
    """Windows still to do: those after the ledger and the failed ones in it."""
    planned = I.with_variants(I.backfill_windows(_sources(spark, sf_dir), 24), ["rsl", "tsl"])
    failed = (F.col("variant") == "tsl") & (F.dayofmonth("window_start") % 4 == 0)
    ledger = planned.where(F.col("window_start") < moment(planned, "window_start", "2024-01-25")).select(
        "source", "window_start", "variant", F.when(failed, "failed").otherwise("done").alias("status")
    )
    return I.open_windows(planned, ledger)


@query(
    with_views("observations", extra={"plan": _PLAN})
    + """SELECT source, max(window_end) AS cursor FROM plan GROUP BY source"""
)
def source_cursors(spark, sf_dir):
    return I.cursors(I.backfill_windows(_sources(spark, sf_dir), 24))


@query(
    with_views("observations", extra={"plan": _PLAN, "planned": "SELECT *, unnest(['rsl', 'tsl', '']) AS variant FROM plan"})
    + """SELECT concat_ws('_', source, strftime(window_start, '%Y%m%dT%H%M%SZ'), strftime(window_end, '%Y%m%dT%H%M%SZ'), nullif(variant, ''), 'data') || '.json' AS filename FROM planned"""
)
def landed_names(spark, sf_dir):
    windows = I.with_variants(I.backfill_windows(_sources(spark, sf_dir), 24), ["rsl", "tsl", ""])
    edges = [window_text(F.col(c)) for c in ("window_start", "window_end")]
    return windows.select(landed_name(F.col("source"), *edges, F.col("variant")).alias("filename"))
