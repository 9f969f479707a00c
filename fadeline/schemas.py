"""Column lists, keys and types of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("cml_id", T.StringType()),
        T.StructField("sublink_id", T.StringType()),
        T.StructField("rsl", T.FloatType()),
        T.StructField("tsl", T.FloatType()),
        T.StructField("user_id", T.StringType()),
    ]
)

LINK = T.StructType(
    [
        T.StructField("cml_id", T.StringType()),
        T.StructField("sublink_id", T.StringType()),
        T.StructField("site_0_lon", T.FloatType()),
        T.StructField("site_0_lat", T.FloatType()),
        T.StructField("site_1_lon", T.FloatType()),
        T.StructField("site_1_lat", T.FloatType()),
        T.StructField("frequency", T.FloatType()),
        T.StructField("polarization", T.StringType()),
        T.StructField("length", T.FloatType()),
        T.StructField("user_id", T.StringType()),
    ]
)

FILE_LOG = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_modified", T.TimestampType()),
    ]
)

OBSERVATION_KEY = ["time", "cml_id", "sublink_id", "user_id"]
LINK_KEY = ["cml_id", "sublink_id", "user_id"]
STATS_KEY = ["user_id", "cml_id"]

RAW_COLUMNS = ["time", "cml_id", "sublink_id", "tsl", "rsl"]
COORDINATES = ["site_0_lon", "site_0_lat", "site_1_lon", "site_1_lat"]
LINK_COLUMNS = ["cml_id", "sublink_id", *COORDINATES, "frequency", "polarization", "length"]
LINK_VALUES = [*COORDINATES, "frequency", "polarization", "length"]

LIFETIME_COLUMNS = [
    "total_records",
    "valid_records",
    "null_records",
    "completeness_percent",
    "min_rsl",
    "max_rsl",
    "mean_rsl",
    "stddev_rsl",
]
WINDOW_COLUMNS = [
    "completeness_percent_6h",
    "total_records_6h",
    "valid_records_6h",
    "mean_rsl_6h",
    "stddev_rsl_6h",
    "completeness_percent_1h",
    "mean_rsl_1h",
    "stddev_rsl_1h",
]

STATUSES = ["archived", "quarantined"]
