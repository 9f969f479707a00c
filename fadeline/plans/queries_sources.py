"""Registered queries: file names, readers, arrays, storage and streams.

The files these queries read are made by Spark from the test tables, in the
work folder, so their size grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.numbers import finite, half_up
from fadeline.functions.times import to_utc
from fadeline.operators import increments, layout, versions
from fadeline.operators.upsert import first_wins
from fadeline.plans import ingest
from fadeline.plans.catalog import half_up_sql as R
from fadeline.plans.catalog import query, with_views
from fadeline.plans.queries_rows import FIRST
from fadeline.plans.queries_stats import AS_OF, LAST, LIFETIME, WINDOW_COLUMNS, WINDOWED, rollup_sql, rounded
from fadeline.plans.store import Store
from fadeline.plans.views import OBSERVATIONS_AS_OF, arrivals, file_log, links, observations, table
from fadeline.schemas import COORDINATES
from fadeline.session import new_path
from fadeline.sources import cube, delimited, json_records
from fadeline.sources.formats import load_format
from fadeline.sources.names import file_kind, longest_prefix, stem, unique_name, upload_refusal
from fadeline.streaming import ingest as stream_ingest_jobs
from fadeline.streaming import rollup as stream_rollups

# The field map of a source whose two levels come in separate files.
FIELD_MAP = {
    "source_rsl": {"time": "timestamp", "cml_id": "link_id", "sublink_id": "sublink_id", "rsl": "value"},
    "source_tsl": {"time": "timestamp", "cml_id": "link_id", "sublink_id": "sublink_id", "tsl": "value"},
}


@query(
    with_views("file_log")
    + """SELECT filename, CASE WHEN lower(filename) LIKE '%.json' THEN 'rawdata' WHEN contains(lower(filename), 'meta') THEN 'metadata'
    WHEN contains(lower(filename), 'raw') OR contains(lower(filename), 'data') THEN 'rawdata' ELSE 'unsupported' END AS kind FROM file_log"""
)
def classify_files(spark, sf_dir):
    log = file_log(spark, sf_dir)
    return log.select("filename", file_kind(F.col("filename"), load_format("demo_csv_data")).alias("kind"))


@query(
    with_views("file_log")
    + """SELECT filename, CASE WHEN starts_with(filename, 'cml_data_1') THEN 'cml_data_1' WHEN starts_with(filename, 'cml_meta') THEN 'cml_meta'
    WHEN starts_with(filename, 'cml_data') THEN 'cml_data' END AS prefix, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM file_log"""
)
def prefix_route(spark, sf_dir):
    name = stem(F.col("filename"))
    prefix = longest_prefix(name, ["cml_data", "cml_meta", "cml_data_1"])
    return file_log(spark, sf_dir).select("filename", prefix.alias("prefix"), name.alias("stem"))


_EXTENSIONS = "CASE doc_id % 6 WHEN 0 THEN '.csv' WHEN 1 THEN '.NC' WHEN 2 THEN '.h5' WHEN 3 THEN '.hdf5' WHEN 4 THEN '.txt' ELSE '' END"


@query(
    f"""SELECT doc_id, size_mb, reason, CASE WHEN reason IS NULL THEN s || '_20240131_000000_' || left(md5(s), 8) || '.' || e END AS stored_as
    FROM (SELECT doc_id, 'upload_' || doc_id AS s, substr({_EXTENSIONS}, 2) AS e, {R('n_chars * 40000 / 1048576e0')} AS size_mb,
    CASE WHEN doc_id % 6 >= 4 THEN 'File type not allowed. Allowed: nc, csv, h5, hdf5'
    WHEN n_chars * 40000 > 524288000 THEN 'File size exceeds 500 MB limit' END AS reason FROM documents)"""
)
def upload_admission(spark, sf_dir):
    """Documents as uploads: 40 kB per character, the file type by number."""
    kinds = F.array(*[F.lit(x) for x in (".csv", ".NC", ".h5", ".hdf5", ".txt", "")])
    name = F.concat(F.lit("upload_"), F.col("doc_id").cast("string"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")))
    files = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), (F.col("n_chars") * 40000).alias("size"))
    reason = upload_refusal(F.col("name"), F.col("size"))
    at = F.lit(OBSERVATIONS_AS_OF).cast("timestamp")
    stored = unique_name(F.col("name"), at, F.md5(stem(F.col("name"))))
    return files.select(
        "doc_id", half_up(F.col("size") / 1048576).alias("size_mb"), reason.alias("reason"), F.when(reason.isNull(), stored).alias("stored_as")
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 AND l_linenumber % 5 <> 0 THEN l_quantity END AS quantity FROM lineitem"""
)
def finite_numbers(spark, sf_dir):
    """NaN and infinities become null."""
    n = F.col("l_linenumber")
    odd = F.when(n % 4 == 0, float("nan")).when(n % 5 == 0, float("-inf")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", finite(odd).alias("quantity"))


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts - INTERVAL 1 HOUR WHEN 1 THEN ts - INTERVAL 330 MINUTE END AS time FROM events"""
)
def local_to_utc(spark, sf_dir):
    """Naive local times, times with an offset, and text that is no time."""
    rows = table(spark, sf_dir, "events")
    naive = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 3
    text = F.when(kind == 0, naive).when(kind == 1, F.concat(naive, F.lit("+05:30"))).otherwise("no time")
    return rows.select("event_id", to_utc(text, "Africa/Douala").cast("timestamp_ntz").alias("time"))


def _csv_lines(spark, sf_dir) -> DataFrame:
    """Events as lines of five files, two of which order their columns differently."""
    rows = observations(spark, sf_dir)
    swapped = F.col("sublink_id").isin("error", "view")
    level = F.when(F.col("rsl") < -150, "n/a").otherwise(F.translate(F.col("rsl").cast("decimal(12,2)").cast("string"), ".", ","))
    fields = {
        "when": F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "link": F.col("cml_id"),
        "sub": F.concat(F.lit('"'), F.col("sublink_id"), F.lit(';1"')),
        "rx": F.coalesce(level, F.lit("")),
        "tx": F.when(F.col("tsl") == 17, "broken").otherwise(F.col("tsl").cast("string")),
    }
    order, other = ["when", "link", "sub", "rx", "tx"], ["tx", "when", "rx", "sub", "link"]
    line = F.when(swapped, F.concat_ws(";", *[fields[c] for c in other])).otherwise(F.concat_ws(";", *[fields[c] for c in order]))
    name = F.concat(F.lit("raw_"), F.col("sublink_id"), F.lit(".csv"))
    place = {
        "filename": name,
        "file_path": F.concat(F.lit("/in/"), name),
        "file_modified": F.lit(OBSERVATIONS_AS_OF).cast("timestamp"),
    }
    data = rows.select(line.alias("value"), *[c.alias(n) for n, c in place.items()], F.lit(1).cast("bigint").alias("block_start"), F.col("seq").alias("line_no"))
    head = F.when(swapped, ";".join(other)).otherwise(";".join(order))
    heads = rows.select("sublink_id").distinct().select(
        head.alias("value"), *[c.alias(n) for n, c in place.items()], F.lit(0).cast("bigint").alias("block_start"), F.lit(0).cast("bigint").alias("line_no")
    )
    return heads.unionByName(data)


_CSV_CONFIG = {
    "read_csv_kwargs": {"sep": ";", "decimal": ","},
    "rawdata_columns": {"when": "time", "link": "cml_id", "sub": "sublink_id", "rx": "rsl", "tx": "tsl"},
    "timezone": "Africa/Douala",
}


@query(
    with_views("observations")
    + """SELECT 'raw_' || sublink_id || '.csv' AS filename, time - INTERVAL 1 HOUR AS time, cml_id, sublink_id || ';1' AS sublink_id,
    CASE WHEN tsl <> 17 THEN tsl END AS tsl, CASE WHEN rsl >= -150 THEN rsl END AS rsl FROM observations"""
)
def delimited_rows(spark, sf_dir):
    """Lines with header, separator, decimal comma, quotes, local time and
    unreadable numbers to canonical rows."""
    rows = delimited.raw_rows(_csv_lines(spark, sf_dir), load_format("csv_generic", _CSV_CONFIG))
    return rows.select("filename", F.col("time").cast("timestamp_ntz").alias("time"), "cml_id", "sublink_id", "tsl", "rsl")


@query(
    with_views("links")
    + """SELECT cml_id, sublink_id, site_0_lon, site_0_lat, CAST(NULL AS DOUBLE) AS site_1_lon, site_1_lat, frequency, polarization, frequency / 8 AS length FROM links"""
)
def delimited_metadata(spark, sf_dir):
    """Metadata lines of the second operator's format."""
    rows = links(spark, sf_dir)
    parts = ["cml_id", "sublink_id", "site_0_lon", "site_0_lat", F.lit("east"), "site_1_lat", "frequency", "polarization", F.col("frequency") / 8]
    line = F.concat_ws(";", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    place = [F.lit("/in/meta.csv").alias("file_path"), F.lit("meta.csv").alias("filename"), F.lit(OBSERVATIONS_AS_OF).cast("timestamp").alias("file_modified")]
    data = rows.select(line.alias("value"), *place, F.lit(1).cast("bigint").alias("block_start"), F.monotonically_increasing_id().alias("line_no"))
    head = spark.range(1).select(
        F.lit("link_id;sublink;lon_a;lat_a;lon_b;lat_b;freq_mhz;pol;length_km").alias("value"), *place,
        F.lit(0).cast("bigint").alias("block_start"), F.lit(0).cast("bigint").alias("line_no"),
    )
    found = delimited.metadata_rows(head.unionByName(data), load_format("other_mno_csv"))
    return found.select("cml_id", "sublink_id", *COORDINATES, "frequency", "polarization", "length")


def _pages(spark, sf_dir, size: int = 100) -> DataFrame:
    """Events as result pages of a hundred records at most; pages of even number
    carry the received level, the others the sent one."""
    page = F.floor(F.col("seq") / size)
    value = F.when(page % 2 == 0, F.col("rsl")).otherwise(F.col("tsl"))
    record = F.struct(
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("cml_id").alias("link_id"), "sublink_id", value.alias("value"), F.col("seq").alias("n"),
    )
    rows = observations(spark, sf_dir).select(page.alias("page"), record.alias("record"))
    pages = rows.groupBy("page").agg(F.collect_list("record").alias("records"), F.count(F.lit(1)).alias("size"))
    options = {"ignoreNullFields": "false"}
    listed = F.to_json("records", options)
    body = (
        F.when(F.col("page") % 3 == 0, listed)
        .when(F.col("page") % 3 == 1, F.concat(F.lit('{"count": '), (F.col("size") + F.col("page") % 2).cast("string"), F.lit(', "results": '), listed, F.lit("}")))
        .otherwise(F.concat(F.lit('{"data": '), listed, F.lit("}")))
    )
    name = F.concat(F.when(F.col("page") % 2 == 0, "source_rsl_").otherwise("source_tsl_"), F.col("page").cast("string"), F.lit(".json"))
    return pages.select(name.alias("filename"), body.alias("body"))


@query(
    with_views("observations")
    + """SELECT CASE WHEN p % 2 = 0 THEN 'source_rsl_' ELSE 'source_tsl_' END || p || '.json' AS filename, time, cml_id, sublink_id,
    CASE WHEN p % 2 = 1 THEN tsl END AS tsl, CASE WHEN p % 2 = 0 THEN rsl END AS rsl FROM (SELECT *, seq // 2000 AS p FROM observations)"""
)
def json_rows(spark, sf_dir):
    """JSON files of records, read through the field map."""
    path = new_path(spark, "json")
    records = increments.page_records(_pages(spark, sf_dir, 2000)).groupBy("filename").agg(F.to_json(F.collect_list("record"), {"ignoreNullFields": "false"}).alias("value"))
    records.select("value", F.regexp_replace("filename", r"\.json$", "").alias("name")).write.partitionBy("name").option("lineSep", "\n").text(path)
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    listed = json_records.with_file(files).withColumn("filename", F.concat(F.regexp_extract("file_path", "name=([^/]*)/", 1), F.lit(".json")))
    found = json_records.raw_rows(listed, FIELD_MAP)
    wrong = json_records.absent_fields(found).select("file_path")
    rows = found.where("header_error IS NULL AND line_no IS NOT NULL").join(wrong, "file_path", "left_anti")
    return rows.select("filename", F.col("time").cast("timestamp_ntz").alias("time"), "cml_id", "sublink_id", "tsl", "rsl")


@query(
    """SELECT CASE WHEN p % 2 = 0 THEN 'source_rsl_' ELSE 'source_tsl_' END || p || '.json' AS filename, CAST(1 AS BIGINT) AS pages, n AS records,
    CASE WHEN p % 3 = 1 THEN n + p % 2 END AS announced, p % 3 <> 1 OR p % 2 = 0 AS complete
    FROM (SELECT event_id // 100 AS p, count(*) AS n FROM events GROUP BY 1)"""
)
def page_completeness(spark, sf_dir):
    return increments.page_completeness(_pages(spark, sf_dir), ["filename"])


def _stretch(first, length) -> Column:
    """Values of an embedding from ``first`` on, null beyond its end."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(F.col("embedding"), (first + i).cast("int")))


def _blocks(spark, sf_dir) -> DataFrame:
    """Each embedding as a block of one link and the steps of 10 s that its length gives:
    four sublinks with a quarter of the values each, and one of padding."""
    steps, nothing = F.col("steps"), F.lit(float("nan")).cast("float")
    quarters = F.array(*[_stretch(k * steps, steps) for k in range(4)], F.transform(F.sequence(F.lit(1), steps), lambda _: nothing))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "embeddings")
        .withColumn("steps", F.ceil(F.size("embedding") / 4).cast("int"))
        .select(
            F.array(F.col("vec_id")).alias("cml_ids"),
            F.array(*[F.lit(s) for s in ("a", "b", "c", "d", "pad")]).alias("sublink_ids"),
            F.transform(F.sequence(F.lit(0), steps - 1), lambda i: start + F.make_dt_interval(secs=i * 10)).alias("times"),
            F.array(quarters).alias("rsl"),
            F.array(F.transform(quarters, lambda a: F.transform(a, lambda x: -x))).alias("tsl"),
        )
    )


_CELLS = """SELECT CAST(vec_id AS VARCHAR) AS cml_id, ['a', 'b', 'c', 'd', 'pad'][s + 1] AS sublink_id,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 10 SECOND * i AS time, s, CASE WHEN s < 4 THEN embedding[s * steps + i + 1] END AS x FROM
    (SELECT vec_id, embedding, (len(embedding) + 3) // 4 AS steps, unnest(range(0, 5)) AS s FROM embeddings) b, LATERAL (SELECT unnest(range(0, steps)) AS i)"""


@query(f"SELECT time, cml_id, sublink_id, -x AS tsl, x AS rsl FROM ({_CELLS})")
def cube_to_rows(spark, sf_dir):
    return cube.to_rows(_blocks(spark, sf_dir), cube.LINK_FIRST)


@query(f"SELECT time, cml_id, sublink_id, -x AS tsl, x AS rsl FROM ({_CELLS}) WHERE s < 4")
def cube_valid_sublinks(spark, sf_dir):
    return cube.valid_rows(_blocks(spark, sf_dir), cube.LINK_FIRST)


_METADATA_SQL = """SELECT vec_id || '-' || i AS cml_id, ['a', 'b', 'c', 'd'][j + 1] AS sublink_id,
    CAST(embedding[i + 1] AS DOUBLE) AS site_0_lon, CAST(embedding[w + i + 1] AS DOUBLE) AS site_0_lat,
    CAST(embedding[2 * w + i + 1] AS DOUBLE) AS site_1_lon, CAST(embedding[3 * w + i + 1] AS DOUBLE) AS site_1_lat,
    CAST(embedding[(4 + j) * w + i + 1] AS DOUBLE) AS frequency, CAST(NULL AS VARCHAR) AS polarization
    FROM (SELECT vec_id, embedding, (len(embedding) + 7) // 8 AS w, unnest(range(0, 4)) AS j FROM embeddings) b, LATERAL (SELECT unnest(range(0, w)) AS i)"""
_METADATA_LENGTH = """2 * 6371000e0 * asin(sqrt(pow(sin(radians(site_1_lat - site_0_lat) / 2), 2) +
    cos(radians(site_0_lat)) * cos(radians(site_1_lat)) * pow(sin(radians(site_1_lon - site_0_lon) / 2), 2)))"""


@query(f"SELECT *, {R(_METADATA_LENGTH, 2)} AS length FROM ({_METADATA_SQL})")
def cube_metadata(spark, sf_dir):
    """Site and frequency arrays to rows; the length comes from the sites.  An eighth of
    an embedding's values are one coordinate of as many links, the other half the
    frequencies of their four sublinks."""
    w = F.col("w")
    block = table(spark, sf_dir, "embeddings").withColumn("w", F.ceil(F.size("embedding") / 8).cast("int")).select(
        F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.concat_ws("-", F.col("vec_id").cast("string"), i.cast("string"))).alias("cml_ids"),
        F.array(*[F.lit(s) for s in ("a", "b", "c", "d")]).alias("sublink_ids"),
        *[_stretch(k * w, w).alias(c) for k, c in enumerate(COORDINATES)],
        F.array(*[_stretch((4 + j) * w, w) for j in range(4)]).alias("frequency"),
    )
    rows = cube.metadata_rows(block, frequency_dims=("sublink_id", "cml_id"))
    return rows.withColumn("length", half_up(F.col("length"), 2))


def _as_stored(rows: DataFrame) -> DataFrame:
    """Stored rows with their levels as double and their time without a zone."""
    return rows.select(
        F.col("time").cast("timestamp_ntz").alias("time"), "cml_id", "sublink_id", "user_id",
        *[F.col(c).cast("double").alias(c) for c in ("rsl", "tsl")],
    )


_REAL = "CAST(CAST({0} AS FLOAT) AS DOUBLE) AS {0}"
_STORED = f"SELECT time, cml_id, sublink_id, user_id, {_REAL.format('rsl')}, {_REAL.format('tsl')} FROM "


def _stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("time", F.col("time").cast("timestamp"))


@query(with_views("arrivals", extra={"first": FIRST}) + _STORED + "first")
def store_first_wins(spark, sf_dir):
    """Two batches, the second one loaded twice, through the stored table."""
    store = Store(spark, new_path(spark, "store"))
    rows = _stamped(arrivals(spark, sf_dir))
    later = F.col("seq") >= 1_000_000_000_000
    store.append_first_wins(rows.where(~later))
    for _ in range(2):
        store.append_first_wins(rows.where(later))
    return _as_stored(store.observations())


@query(
    with_views("arrivals")
    + f", filled AS (SELECT time, cml_id, sublink_id, user_id, arg_min(rsl, seq) FILTER (WHERE rsl IS NOT NULL) AS rsl, "
    f"arg_min(tsl, seq) FILTER (WHERE tsl IS NOT NULL) AS tsl FROM arrivals GROUP BY ALL) {_STORED} filled"
)
def store_fill_nulls(spark, sf_dir):
    store = Store(spark, new_path(spark, "store"))
    rows = _stamped(arrivals(spark, sf_dir))
    later = F.col("seq") >= 1_000_000_000_000
    store.append_first_wins(rows.where(~later))
    store.fill_nulls(rows.where(later))
    return _as_stored(store.observations())


@query(with_views("arrivals", extra={"first": FIRST}) + "SELECT * EXCLUDE seq FROM first")
def dedup_rewrite(spark, sf_dir):
    """A table with repeated keys is deduplicated and rewritten by partition."""
    path = new_path(spark, "table")
    arrivals_dated = layout.with_date(arrivals(spark, sf_dir))
    layout.write_observations(arrivals_dated, path)
    layout.replace_observations(first_wins(versions.read(spark, path)).drop("seq"), path)
    return _as_stored(versions.read(spark, path))


@query(with_views("observations") + _STORED + "observations")
def compacted_table(spark, sf_dir):
    """Clustered write, then the old days rewritten."""
    path = new_path(spark, "table")
    layout.write_observations(observations(spark, sf_dir).drop("seq"), path)
    layout.compact(spark, path, OBSERVATIONS_AS_OF)
    return _as_stored(versions.read(spark, path)).withColumns({c: F.col(c).cast("float").cast("double") for c in ("rsl", "tsl")})


@query(
    with_views("observations")
    + "SELECT * FROM observations WHERE time BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-22 12:00:00'"
)
def pruned_range(spark, sf_dir):
    """A time range read from the day folders it needs."""
    path = new_path(spark, "table")
    layout.write_observations(observations(spark, sf_dir), path)
    return layout.read_range(spark, path, "2024-01-20", "2024-01-22 12:00:00").drop("date")


def _with_time_text(rows: DataFrame) -> DataFrame:
    text = F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select(text.alias("time"), "cml_id", "sublink_id", "tsl", "rsl")


def _write_archive(spark, sf_dir) -> tuple[str, str]:
    root = new_path(spark, "archive")
    _with_time_text(observations(spark, sf_dir)).write.option("header", True).csv(f"{root}/data")
    rows = links(spark, sf_dir)
    rows.select(
        "cml_id", "sublink_id", *COORDINATES, "frequency", F.lit(1.5).alias("length"), "polarization"
    ).write.option("header", True).csv(f"{root}/metadata")
    return f"{root}/data", f"{root}/metadata"


SERIES_WHERE = "time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-26 13:00:00'"
_FLOAT_OBS = "SELECT * REPLACE (CAST(rsl AS FLOAT) AS rsl, CAST(tsl AS FLOAT) AS tsl, 'archive' AS user_id) FROM observations"


@query(
    with_views("observations", extra={"loaded": _FLOAT_OBS})
    + "SELECT bucket, user_id, cml_id, sublink_id, CAST(rsl_min AS DOUBLE) AS rsl_min, CAST(rsl_max AS DOUBLE) AS rsl_max, rsl_avg, "
    + f"CAST(tsl_min AS DOUBLE) AS tsl_min, CAST(tsl_max AS DOUBLE) AS tsl_max, tsl_avg FROM ({rollup_sql('loaded').replace('avg(rsl)', 'avg(CAST(rsl AS DOUBLE))').replace('avg(tsl)', 'avg(CAST(tsl AS DOUBLE))')})"
)
def archive_rollup(spark, sf_dir):
    """Archive files loaded in bulk; the rollup is refreshed as a whole."""
    store = Store(spark, new_path(spark, "store"))
    data, metadata = _write_archive(spark, sf_dir)
    ingest.load_archive(spark, store, data, metadata, "archive", OBSERVATIONS_AS_OF)
    rolled = rounded(store.rollup()).drop("date").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    return rolled.withColumns({c: F.col(c).cast("double") for c in ("rsl_min", "rsl_max", "tsl_min", "tsl_max")})


@query(
    with_views("observations", extra={"loaded": _FLOAT_OBS.replace("'archive'", "user_id")})
    + "SELECT bucket, user_id, cml_id, sublink_id, CAST(rsl_min AS DOUBLE) AS rsl_min, CAST(rsl_max AS DOUBLE) AS rsl_max, rsl_avg, "
    + f"CAST(tsl_min AS DOUBLE) AS tsl_min, CAST(tsl_max AS DOUBLE) AS tsl_max, tsl_avg FROM ({rollup_sql('loaded', SERIES_WHERE).replace('avg(rsl)', 'avg(CAST(rsl AS DOUBLE))').replace('avg(tsl)', 'avg(CAST(tsl AS DOUBLE))')})"
)
def series_range(spark, sf_dir):
    """A long range over a rollup that was published five days before its end."""
    store = Store(spark, new_path(spark, "store"))
    rows = _stamped(observations(spark, sf_dir))
    store.load_unique(rows.where("time < timestamp'2024-01-21 00:00:00'"), mode="overwrite")
    store.refresh_full_rollup()
    store.load_unique(rows.where("time >= timestamp'2024-01-21 00:00:00'"))
    rolled = rounded(store.series("2024-01-10 00:00:00", "2024-01-26 12:00:00")).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    return rolled.withColumns({c: F.col(c).cast("double") for c in ("rsl_min", "rsl_max", "tsl_min", "tsl_max")})


@query(with_views("observations") + "SELECT min(time) AS start_time, max(time) AS end_time, count(*) AS total_rows FROM observations")
def archive_replace_all(spark, sf_dir):
    """An archive loaded over an older one leaves only its own rows."""
    store = Store(spark, new_path(spark, "store"))
    data, metadata = _write_archive(spark, sf_dir)
    ingest.load_archive(spark, store, data, metadata, "older", OBSERVATIONS_AS_OF)
    summary = ingest.load_archive(spark, store, data, metadata, "archive", OBSERVATIONS_AS_OF, replace_all=True)
    return summary.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events file as a stream of observations."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    level = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return stream.withColumn("k", level).select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("user_id").cast("string").alias("cml_id"),
        F.col("event_type").alias("sublink_id"),
        F.when(F.col("k") % 10 != 0, 0 - F.col("value")).alias("rsl"),
        F.col("k").cast("double").alias("tsl"),
        F.when(F.col("user_id") % 3 == 0, "tenant_b").otherwise("tenant_a").alias("user_id"),
        F.explode(F.when(F.col("k") >= 90, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


@query(with_views("observations") + rollup_sql())
def stream_rollup(spark, sf_dir):
    """The hourly rollup kept by a stream."""
    root = new_path(spark, "stream")
    rows = _event_stream(spark, sf_dir).where("copy = 0").drop("copy")
    stream_rollups.start_rollup(rows, f"{root}/rollup", f"{root}/checkpoint").awaitTermination()
    rolled = stream_rollups.read_rollup(spark, f"{root}/rollup")
    return rounded(rolled).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(with_views("observations") + "SELECT time, cml_id, sublink_id, user_id FROM observations")
def stream_dedup(spark, sf_dir):
    """Replayed rows are dropped in the stream."""
    root = new_path(spark, "stream")
    stream_rollups.start_first_wins(_event_stream(spark, sf_dir), f"{root}/table", f"{root}/checkpoint", order="copy").awaitTermination()
    kept = versions.read(spark, f"{root}/table")
    return kept.select(F.col("time").cast("timestamp_ntz").alias("time"), "cml_id", "sublink_id", "user_id")


PANE_TIMES = ("2024-01-30 23:17:00", "2024-01-20 06:00:00", "2024-01-03 00:01:00")


@query(
    with_views("observations", "links")
    + f", {LAST} "
    + " UNION ALL ".join(
        f"(WITH {WINDOWED.replace(AS_OF, f"TIMESTAMP '{t}'")} SELECT TIMESTAMP '{t}' AS as_of, user_id, cml_id, {WINDOW_COLUMNS}, last_rsl FROM windowed LEFT JOIN last USING (user_id, cml_id))"
        for t in PANE_TIMES
    )
)
def stream_windowed_stats(spark, sf_dir):
    """Windowed statistics at several times from the minutes that a stream has kept."""
    root = new_path(spark, "stream")
    rows = _event_stream(spark, sf_dir).where("copy = 0").drop("copy")
    stream_rollups.start_panes(rows, f"{root}/panes", f"{root}/checkpoint").awaitTermination()
    known = links(spark, sf_dir)
    found = [stream_rollups.windowed_stats(spark, f"{root}/panes", known, t).withColumn("as_of", F.lit(t).cast("timestamp_ntz")) for t in PANE_TIMES]
    return reduce(DataFrame.unionByName, found)


@query(
    with_views("observations", extra={"loaded": _FLOAT_OBS.replace("'archive'", "user_id")})
    + f", {LAST.replace('observations', 'loaded')}, {LIFETIME.replace('observations', 'loaded').replace('avg(rsl)', 'avg(CAST(rsl AS DOUBLE))').replace('stddev_samp(rsl)', 'stddev_samp(CAST(rsl AS DOUBLE))')} "
    "SELECT lifetime.* REPLACE (CAST(min_rsl AS DOUBLE) AS min_rsl, CAST(max_rsl AS DOUBLE) AS max_rsl), CAST(last_rsl AS DOUBLE) AS last_rsl FROM lifetime JOIN last USING (user_id, cml_id)"
)
def store_daily_stats(spark, sf_dir):
    """Lifetime statistics after three batches, each folded into the stored partials;
    the second one comes twice."""
    store = Store(spark, new_path(spark, "store"))
    rows = _stamped(observations(spark, sf_dir))
    for third in (0, 1, 1, 2):
        store.append_first_wins(rows.where(F.pmod("tsl", F.lit(3)) == third))
        store.refresh_daily_stats()
    store.refresh_lifetime_stats(OBSERVATIONS_AS_OF)
    kept = store.link_stats().withColumns({c: F.col(c).cast("double") for c in ("min_rsl", "max_rsl", "last_rsl")})
    return kept.select("user_id", "cml_id", "total_records", "valid_records", "null_records", "completeness_percent", "min_rsl", "max_rsl", "mean_rsl", "stddev_rsl", "last_rsl")


def _write_incoming(spark, sf_dir) -> str:
    path = new_path(spark, "incoming")
    _with_time_text(observations(spark, sf_dir)).repartition(8, "sublink_id").write.option("header", True).csv(path)
    return path


@query(
    with_views("observations", extra={"loaded": _FLOAT_OBS})
    + f", {LAST.replace('observations', 'loaded')}, {LIFETIME.replace('observations', 'loaded').replace('avg(rsl)', 'avg(CAST(rsl AS DOUBLE))').replace('stddev_samp(rsl)', 'stddev_samp(CAST(rsl AS DOUBLE))')} "
    "SELECT lifetime.* REPLACE (CAST(min_rsl AS DOUBLE) AS min_rsl, CAST(max_rsl AS DOUBLE) AS max_rsl), CAST(last_rsl AS DOUBLE) AS last_rsl FROM lifetime JOIN last USING (user_id, cml_id)"
)
def stream_ingest(spark, sf_dir):
    """CSV files taken up by the watching stream; the statistics it leaves."""
    job = ingest.Job(Store(spark, new_path(spark, "store")), load_format("csv_generic"), "archive")
    path = _write_incoming(spark, sf_dir)
    stream_ingest_jobs.watch_delimited(spark, job, path, new_path(spark, "checkpoint"), as_of=OBSERVATIONS_AS_OF).awaitTermination()
    kept = job.store.link_stats()
    return kept.select("user_id", "cml_id", "total_records", "valid_records", "null_records", "completeness_percent", "min_rsl", "max_rsl", "mean_rsl", "stddev_rsl", "last_rsl")
