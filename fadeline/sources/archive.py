"""Archive files in fixed column order, read with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column order of the two archive files.
RAW_SCHEMA = "time timestamp, cml_id string, sublink_id string, tsl double, rsl double"
METADATA_SCHEMA = (
    "cml_id string, sublink_id string, site_0_lon double, site_0_lat double, site_1_lon double, "
    "site_1_lat double, frequency double, length double, polarization string"
)


def read_raw(spark: SparkSession, path, user_id: str) -> DataFrame:
    """Observations of an archive, tagged with the tenant.  A malformed row is
    an error, as in a bulk copy."""
    rows = spark.read.schema(RAW_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("user_id", F.lit(user_id))


def read_metadata(spark: SparkSession, path, user_id: str) -> DataFrame:
    rows = spark.read.schema(METADATA_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return rows.withColumn("user_id", F.lit(user_id))
