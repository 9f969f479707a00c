"""The model tables as views on the driver's TPC-H-like test tables.

``observations`` is the stored table (unique keys), ``arrivals`` the stream of
rows that leads to it: some keys arrive a second time with other values, and
some of the first arrivals have no received level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The event types double as sublink ids.
SUBLINKS = ["click", "error", "purchase", "signup", "view"]
TENANTS = frozenset({"tenant_a", "tenant_b"})
OBSERVATIONS_AS_OF = "2024-01-31 00:00:00"
LOG_AS_OF = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tenant(number: str) -> Column:
    return F.when(F.col(number) % 3 == 0, "tenant_b").otherwise("tenant_a")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return table(spark, sf_dir, "events").withColumn("k", level)


def _observed(events: DataFrame) -> list[Column]:
    return [
        F.col("ts").alias("time"),
        F.col("user_id").cast("string").alias("cml_id"),
        F.col("event_type").alias("sublink_id"),
    ]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.select(
        F.col("event_id").alias("seq"),
        *_observed(rows),
        F.when(F.col("k") % 10 != 0, 0 - F.col("value")).alias("rsl"),
        F.col("k").cast("double").alias("tsl"),
        _tenant("user_id").alias("user_id"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals, and second ones for levels from 90 on, in one scan."""
    copies = F.when(F.col("k") >= 90, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = _events(spark, sf_dir).withColumn("copy", F.explode(copies))
    first = F.col("copy") == 0
    return rows.select(
        F.when(first, F.col("event_id")).otherwise(F.col("event_id") + 1_000_000_000_000).alias("seq"),
        *_observed(rows),
        F.when(~first, (0 - F.col("value")) - 1).when(F.col("k") % 10 != 0, 0 - F.col("value")).alias("rsl"),
        F.when(first | (F.col("k") < 97), F.col("k").cast("double")).alias("tsl"),
        _tenant("user_id").alias("user_id"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sublinks for each customer.  Those with a negative balance belong to
    another network, under ids of its own: data of such customers have no
    metadata, and those links have no data.

    A small file of customers is read by one task and makes many more bytes of
    links: rows are dealt out anew while they are narrow, so that no task works
    through all links, and joins know how many there are."""
    site = {
        "site_0_lon": (11.0, 50),
        "site_0_lat": (57.0, 40),
        "site_1_lon": (11.004, 50),
        "site_1_lat": (56.994, 40),
    }
    sublinks = F.explode(F.array(*[F.lit(s) for s in SUBLINKS]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", sublinks.alias("sublink_id")).hint("rebalance")
    other = F.when(F.col("c_acctbal") < 0, "other-").otherwise("")
    return rows.select(
        F.concat(other, F.col("c_custkey").cast("string")).alias("cml_id"),
        "sublink_id",
        *[F.round(start + (F.col("c_custkey") % wrap) * 0.01, 3).alias(name) for name, (start, wrap) in site.items()],
        (F.lit(18.0) + F.length("sublink_id")).alias("frequency"),
        F.when(F.col("c_custkey") % 2 == 0, "H").otherwise("V").alias("polarization"),
        _tenant("c_custkey").alias("user_id"),
    )


def file_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("o_orderstatus") == "P"
    kind = (
        F.when(F.col("o_orderkey") % 7 == 0, "meta")
        .when(F.col("o_orderkey") % 11 == 0, "notes")
        .otherwise("data")
    )
    suffix = F.when(F.col("o_orderkey") % 13 == 0, ".json").otherwise(".csv")
    detail = F.when(F.col("o_totalprice") > 300000, F.lit(" while reading a field that has no closing quote before the end of the file is reached"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        _tenant("o_custkey").alias("user_id"),
        F.concat(F.lit("cml_"), kind, F.lit("_"), F.col("o_orderkey").cast("string"), suffix).alias("filename"),
        F.when(bad, "quarantined").otherwise("archived").alias("status"),
        F.when(~bad, F.col("o_custkey").cast("int")).alias("rows_written"),
        F.when(bad, F.concat(F.lit("Parse error: "), F.col("o_orderpriority"), F.coalesce(detail, F.lit("")))).alias("error_message"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("processed_at"),
    )
