"""Registered queries: real files, written from the test tables and read back.

The files lie in the work folder and are as large as the tables they come from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fadeline.functions.identity import id_text, stored_sublink
from fadeline.operators import increments, series, upsert, validate, versions
from fadeline.operators import links as L
from fadeline.operators.tenancy import TenantScope
from fadeline.plans import ingest, sql_functions
from fadeline.plans.catalog import query, with_views
from fadeline.plans.queries_stats import LAST, LIFETIME, WINDOW_COLUMNS, WINDOWED
from fadeline.plans.store import Store
from fadeline.plans.views import OBSERVATIONS_AS_OF, TENANTS, links, observations
from fadeline.schemas import COORDINATES, LINK_COLUMNS, RAW_COLUMNS
from fadeline.session import new_path
from fadeline.sources import archive, delimited
from fadeline.sources.formats import load_format
from fadeline.streaming import ingest as stream_ingest_jobs

MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _texts(rows: DataFrame) -> DataFrame:
    """Observations as the text of canonical files: every 13th sent level without a
    link, every 17th with a level that is no number, every 19th without a sublink."""
    number = lambda c: F.coalesce(F.col(c).cast("decimal(12,2)").cast("string"), F.lit(""))
    return rows.select(
        F.date_format("time", MICROS).alias("time"),
        F.when(F.col("tsl") % 13 != 0, F.col("cml_id")).alias("cml_id"),
        F.when(F.col("tsl") % 19 == 0, "nan").otherwise(F.col("sublink_id")).alias("sublink_id"),
        F.when(F.col("tsl") % 17 == 0, "broken").otherwise(number("tsl")).alias("tsl"),
        number("rsl").alias("rsl"),
    )


_READ = "CASE WHEN tsl % 17 <> 0 THEN tsl END AS tsl, CAST(CAST(rsl AS DECIMAL(12,2)) AS DOUBLE) AS rsl"


def _ntz(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    with_views("observations")
    + f"SELECT time, CASE WHEN tsl % 13 <> 0 THEN cml_id ELSE 'nan' END AS cml_id, CASE WHEN tsl % 19 <> 0 THEN sublink_id END AS sublink_id, {_READ} FROM observations"
)
def canonical_files(spark, sf_dir):
    """Canonical CSV files of a folder with files of other kinds and a folder in it; a
    missing link is the text ``nan``, a sublink ``nan`` is missing."""
    path, rows = new_path(spark, "canonical"), _texts(observations(spark, sf_dir))
    rows.write.option("header", True).option("emptyValue", "").csv(path)
    rows.limit(5).select(F.concat_ws(",", "time", "rsl").alias("value")).write.mode("append").text(path)
    rows.limit(5).write.option("header", True).csv(f"{path}/older.csv")
    found = delimited.read_raw(spark, path, load_format("demo_csv_data"), "part-*.csv")
    return _ntz(found.withColumn("sublink_id", stored_sublink(F.col("sublink_id"))).select(*RAW_COLUMNS))


def _link_texts(spark, sf_dir) -> DataFrame:
    """Links as text; a site without a longitude for every polarization V of sublink view."""
    rows = links(spark, sf_dir).withColumn("length", F.col("frequency") / 8)
    lost = (F.col("polarization") == "V") & (F.col("sublink_id") == "view")
    return rows.withColumn("site_0_lon", F.when(lost, "unknown").otherwise(F.col("site_0_lon").cast("string")))


_LINKS = """SELECT cml_id, sublink_id, CASE WHEN NOT (polarization = 'V' AND sublink_id = 'view') THEN site_0_lon END AS site_0_lon, site_0_lat,
    site_1_lon, site_1_lat, frequency, polarization, frequency / 8 AS length FROM links"""


@query(with_views("links") + _LINKS)
def canonical_metadata_files(spark, sf_dir):
    """Canonical metadata CSV; coordinates that are no numbers become null."""
    path = new_path(spark, "metadata")
    _link_texts(spark, sf_dir).select(*LINK_COLUMNS).write.option("header", True).csv(path)
    return delimited.read_metadata(spark, path, load_format("demo_csv_data"), "*.csv").select(*LINK_COLUMNS)


@query(with_views("links") + _LINKS)
def configured_metadata_files(spark, sf_dir):
    """Metadata with other names, separator, decimal comma, and frequencies in MHz."""
    path, names = new_path(spark, "metadata"), {"link": "cml_id", "sub": "sublink_id", "mhz": "frequency", "km": "length", "pol": "polarization"}
    comma = lambda c: F.translate(F.col(c).cast("string"), ".", ",")
    texts = {c: comma(c) for c in COORDINATES} | {"frequency": comma("frequency").alias("frequency"), "length": comma("length")}
    rows = _link_texts(spark, sf_dir).withColumn("frequency", F.col("frequency") * 1000).withColumns(texts)
    rows.select(*LINK_COLUMNS).withColumnsRenamed({v: k for k, v in names.items()}).write.option("header", True).option("sep", ";").csv(path)
    config = {"read_csv_kwargs": {"sep": ";", "decimal": ","}, "metadata_columns": names, "frequency_factor": 0.001}
    found = delimited.read_metadata(spark, path, load_format("csv_generic", config), "*.csv")
    return found.select(*LINK_COLUMNS).withColumn("frequency", F.round("frequency", 9))


@query(
    with_views("observations")
    + f"SELECT time - INTERVAL 330 MINUTE AS time, CASE WHEN tsl % 13 <> 0 THEN cml_id ELSE 'nan' END AS cml_id, CASE WHEN tsl % 19 <> 0 THEN sublink_id END AS sublink_id, {_READ} FROM observations"
)
def other_operator_files(spark, sf_dir):
    """The second operator's files: its names, semicolons, times with an offset."""
    path, rows = new_path(spark, "other"), _texts(observations(spark, sf_dir)).withColumn("time", F.concat("time", F.lit("+05:30")))
    names = {"time": "timestamp", "cml_id": "link_id", "sublink_id": "sublink", "tsl": "tx_power", "rsl": "rx_power"}
    rows.withColumnsRenamed(names).write.option("header", True).option("sep", ";").option("emptyValue", "").csv(path)
    return _ntz(delimited.read_raw(spark, path, load_format("other_mno_csv"), "*.csv").select(*RAW_COLUMNS))


@query(
    with_views("links")
    + "SELECT cml_id, sublink_id, CAST(CAST(CASE WHEN polarization = 'H' THEN 99 ELSE frequency END AS FLOAT) AS DOUBLE) AS frequency, "
    "CASE WHEN polarization = 'H' THEN 3e0 ELSE 1.5e0 END AS length FROM links"
)
def archive_metadata(spark, sf_dir):
    """Archive metadata, length before polarization; rows that are stored stay."""
    store, path = Store(spark, new_path(spark, "store")), new_path(spark, "archive")
    rows = links(spark, sf_dir).drop("user_id")
    known = rows.where("polarization = 'H'").withColumns({"frequency": F.lit(99.0), "length": F.lit(3.0), "user_id": F.lit("archive")})
    store.insert_links(known)
    columns = ["cml_id", "sublink_id", *COORDINATES, "frequency", "length", "polarization"]
    rows.withColumn("length", F.lit(1.5)).select(*columns).write.option("header", True).csv(path)
    store.insert_links(archive.read_metadata(spark, path, "archive"))
    return store.links().select("cml_id", "sublink_id", F.col("frequency").cast("double").alias("frequency"), F.col("length").cast("double").alias("length"))


def _ingested(spark, sf_dir) -> ingest.Job:
    """Good files, and files of the sublink ``error`` whose rows have no time."""
    path, job = new_path(spark, "incoming"), ingest.Job(Store(spark, new_path(spark, "store")), load_format("csv_generic"), "archive")
    rows = observations(spark, sf_dir).select(F.date_format("time", MICROS).alias("time"), "cml_id", "sublink_id", F.col("tsl").cast("string").alias("tsl"), F.col("rsl").cast("decimal(12,2)").cast("string").alias("rsl"))
    bad = F.col("sublink_id") == "error"
    for some in (rows.where(~bad), rows.where(bad).withColumn("time", F.lit(None).cast("string"))):
        some.repartition(4, "sublink_id", "cml_id").write.mode("append").option("header", True).csv(path)
    ingest.ingest_folder(spark, job, path, OBSERVATIONS_AS_OF)
    return job


_LINE = "cml_id || ',' || sublink_id || ',' || CAST(tsl AS VARCHAR) || ',' || coalesce(CAST(CAST(rsl AS DECIMAL(12,2)) AS VARCHAR), '')"


@query(with_views("observations") + f"SELECT strftime(time, '%Y-%m-%d %H:%M:%S.%f') || ',' || {_LINE} AS line, DATE '{OBSERVATIONS_AS_OF[:10]}' AS processing_date FROM observations WHERE sublink_id <> 'error'")
def archived_lines(spark, sf_dir):
    """Lines of the good files in the archive, compressed, under their processing date."""
    job = _ingested(spark, sf_dir)
    kept = spark.read.text(job.store.path("archive")).where("NOT startswith(value, 'time,')")
    return kept.select(F.col("value").alias("line"), "processing_date")


@query(with_views("observations") + f"SELECT ',' || {_LINE} AS line, 'time is null' AS reason, DATE '{OBSERVATIONS_AS_OF[:10]}' AS date FROM observations WHERE sublink_id = 'error'")
def quarantined_lines(spark, sf_dir):
    """Lines of the bad files in quarantine, each with its reason."""
    job = _ingested(spark, sf_dir)
    kept = spark.read.parquet(job.store.path("quarantine")).where("NOT startswith(line, 'time,')")
    return kept.select("line", "reason", "date")


_DOUBLE_WINDOWED = WINDOWED.replace("observations", "loaded").replace("avg(rsl)", "avg(CAST(rsl AS DOUBLE))").replace("stddev_samp(rsl)", "stddev_samp(CAST(rsl AS DOUBLE))")


@query(
    with_views("observations", "links", extra={"loaded": "SELECT * REPLACE (CAST(rsl AS FLOAT) AS rsl) FROM observations"})
    + f", {_DOUBLE_WINDOWED} SELECT user_id, cml_id, {WINDOW_COLUMNS} FROM windowed"
)
def refreshed_statistics(spark, sf_dir):
    """What the minute's refresh leaves in the table of statistics."""
    job = ingest.Job(Store(spark, new_path(spark, "store")), load_format("csv_generic"), "archive")
    rows = observations(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    job.store.load_unique(rows)
    job.store.replace_links(links(spark, sf_dir).withColumn("length", F.lit(1.0)))
    for _ in range(2):
        stream_ingest_jobs.refresh_statistics(job, OBSERVATIONS_AS_OF)
    return job.store.link_stats().select("user_id", "cml_id", *WINDOW_COLUMNS.split(", "))


@query(
    with_views("observations")
    + """SELECT kind, valid FROM (VALUES ('rawdata', true), ('rawdata without a column', false), ('rawdata without rows', false),
    ('rawdata without a time', false), ('metadata', true), ('other', false)) v(kind, valid) WHERE (SELECT count(*) FROM observations) > 0"""
)
def frame_verdicts(spark, sf_dir):
    """Frames taken as one file each: columns, rows, times, coordinates."""
    rows, known = observations(spark, sf_dir).select(*RAW_COLUMNS), links(spark, sf_dir).withColumn("length", F.lit(1.0))
    frames = [
        ("rawdata", rows, "rawdata"), ("rawdata without a column", rows.drop("rsl"), "rawdata"), ("rawdata without rows", rows.limit(0), "rawdata"),
        ("rawdata without a time", rows.withColumn("time", F.when(F.col("tsl") > 1, F.col("time"))), "rawdata"), ("metadata", known, "metadata"), ("other", rows, "weather"),
    ]
    return reduce(DataFrame.unionByName, [validate.validate_frame(df, kind).select(F.lit(name).alias("kind"), "valid") for name, df, kind in frames])


@query(with_views("observations") + "SELECT time, cml_id, sublink_id, rsl, 'tenant_b' AS user_id FROM observations")
def stamped_rows(spark, sf_dir):
    """The writer's tenant on each row, whatever the row said; an unknown one is an error."""
    try:
        TenantScope("nobody", TENANTS)
    except ValueError:
        return TenantScope("tenant_b", TENANTS).stamp(observations(spark, sf_dir)).select("time", "cml_id", "sublink_id", "rsl", "user_id")
    raise AssertionError("an unknown tenant was let in")


@query(with_views("observations") + "SELECT time, cml_id, sublink_id, user_id, rsl, tsl FROM observations")
def overlapping_windows(spark, sf_dir):
    """Days asked for with an overlap of six hours; rows that come twice are absorbed by their key."""
    rows = observations(spark, sf_dir)
    days = rows.select(F.date_trunc("day", "time").cast("timestamp_ntz").alias("cursor")).distinct().withColumn("source", F.date_format("cursor", "yyyy-MM-dd"))
    windows = increments.continuous_window(days, "2030-01-01 00:00:00", 24, 6 * 3600)
    touched = windows.withColumn("day", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))))
    within = (F.to_date("time") == F.col("day")) & (F.col("time") >= F.col("window_start")) & (F.col("time") < F.col("window_end"))
    fetched = rows.drop("seq").join(touched, within).withColumn("seq", F.unix_timestamp(F.col("window_start").cast("timestamp")))
    return upsert.first_wins(fetched).select("time", "cml_id", "sublink_id", "user_id", "rsl", "tsl")


@query(
    with_views("observations")
    + "SELECT seq, CASE WHEN tsl % 13 <> 0 THEN cml_id ELSE 'nan' END AS cml_id, CASE WHEN tsl % 19 <> 0 THEN sublink_id END AS sublink_id FROM observations"
)
def stored_ids(spark, sf_dir):
    """Ids as they are stored: a missing link as ``nan``, a sublink ``nan`` as missing."""
    rows = observations(spark, sf_dir)
    link, sub = F.when(F.col("tsl") % 13 != 0, F.col("cml_id")), F.when(F.col("tsl") % 19 == 0, "nan").otherwise(F.col("sublink_id"))
    return rows.select("seq", id_text(link).alias("cml_id"), stored_sublink(sub).alias("sublink_id"))


@query(
    with_views("observations")
    + "SELECT 'cml_data_' || strftime(time_bucket(INTERVAL 6 HOUR, time, TIMESTAMP '1970-01-01'), '%Y%m%d_%H%M%S') || '.csv' AS period_file, time, cml_id, sublink_id, tsl, rsl FROM observations"
)
def period_files(spark, sf_dir):
    """A file for every six hours, the second half of them written twice, and read back."""
    path, rows = new_path(spark, "periods"), observations(spark, sf_dir).select(*RAW_COLUMNS)
    series.write_periods(rows, path, "6 hours")
    series.write_periods(rows.where("time >= timestamp_ntz'2024-01-16 00:00:00'"), path, "6 hours")
    kinds = "time timestamp_ntz, cml_id string, sublink_id string, tsl double, rsl double, period_file string"
    return spark.read.option("header", True).option("timestampNTZFormat", MICROS).schema(kinds).csv(path).select("period_file", *RAW_COLUMNS)


@query(
    with_views("observations")
    + "SELECT user_id, date_trunc('month', time) AS month, count(DISTINCT cml_id) AS links, count(DISTINCT (cml_id, sublink_id)) AS sublinks, true AS links_close, true AS sublinks_close FROM observations GROUP BY 1, 2"
)
def distinct_per_month(spark, sf_dir):
    """Links and sublinks a month: exact numbers, and whether those of stored daily
    sketches lie within their stated error."""
    rows, path = observations(spark, sf_dir), new_path(spark, "sketches")
    month = F.date_trunc("month", "time").cast("timestamp_ntz").alias("month")
    versions.write(L.distinct_sketches(rows.withColumn("date", F.to_date("time")), ["date"]), path, ["date"])
    sketched = L.merged_distinct(versions.read(spark, path).withColumn("month", F.date_trunc("month", "date").cast("timestamp_ntz")), ["month"])
    sublink = F.struct("cml_id", "sublink_id")
    exact = rows.groupBy("user_id", month).agg(F.count_distinct("cml_id").alias("links"), F.count_distinct(sublink).alias("sublinks"))
    close = lambda kind: (F.abs(F.col(f"distinct_{kind}") - F.col(kind)) <= F.greatest(F.lit(1), F.col(kind) * L.SKETCH_ERROR)).alias(f"{kind}_close")
    return exact.join(sketched, ["user_id", "month"]).select("user_id", "month", "links", "sublinks", close("links"), close("sublinks"))


@query(
    with_views("observations", "links")
    + f", {LAST}, {LIFETIME}, {WINDOWED} SELECT lifetime.*, last_rsl, {WINDOW_COLUMNS} FROM lifetime JOIN last USING (user_id, cml_id) JOIN windowed USING (user_id, cml_id)"
)
def table_functions(spark, sf_dir):
    """Lifetime statistics of both tenants and windowed ones, called in SQL."""
    sql_functions.register(spark, observations(spark, sf_dir), links(spark, sf_dir))
    every = " UNION ALL ".join(f"SELECT * FROM lifetime_statistics('{tenant}')" for tenant in sorted(TENANTS))
    return spark.sql(f"SELECT * FROM ({every}) JOIN windowed_statistics(TIMESTAMP_NTZ '{OBSERVATIONS_AS_OF}') USING (user_id, cml_id)")
