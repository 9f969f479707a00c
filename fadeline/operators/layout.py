"""How tables lie on disk.

Observations are partitioned by tenant and day and sorted by link and falling
time inside each file, so that a tenant and a time range prune folders and a
link prunes row groups.  ``rebalance`` lets adaptive execution split a tenant
or day that holds a third of the rows and merge the small ones.  All tables are
``versions``: a write takes effect as a whole.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.functions.times import as_datetime
from fadeline.operators import versions

OBSERVATION_PARTITIONS = ["user_id", "date"]
COMPACT_CODEC = "zstd"


def days_between(start=None, end=None):
    """Whether a folder's day lies in a time range, for ``versions.read``."""
    first, last = (None if t is None else as_datetime(t).date().isoformat() for t in (start, end))

    def only(values: dict[str, str]) -> bool:
        day = values.get("date", "")
        return not day[:1].isdigit() or (first is None or day >= first) and (last is None or day <= last)

    return only


def of_days(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows of the days, and of the tenants, that ``rows`` touch, as filters
    on folders.  Days are as many as the calendar has and tenants as many as
    accounts, so both are listed."""
    names = [c for c in OBSERVATION_PARTITIONS if c in rows.columns and c in stored.columns]
    touched = rows.agg(*[F.collect_set(c).alias(c) for c in names]).first()
    for name in names:
        stored = stored.where(F.col(name).isin(touched[name])) if touched[name] else stored.limit(0)
    return stored


def with_date(df: DataFrame, column: str = "time") -> DataFrame:
    return df.withColumn("date", F.to_date(F.col(column)))


def clustered(observations: DataFrame) -> DataFrame:
    rows = observations if "date" in observations.columns else with_date(observations)
    return rows.hint("rebalance", *OBSERVATION_PARTITIONS).sortWithinPartitions(
        *OBSERVATION_PARTITIONS, "cml_id", F.desc("time")
    )


def bulk_clustered(observations: DataFrame) -> DataFrame:
    """The same order for a large load, by ranges of tenant, day, link and time.

    Ranges stay even when one link holds a third of the rows, and a task writes
    few folders however many days there are.  Sampling reads the rows once more,
    so this is for staged files; there are as many ranges as files have splits.
    """
    rows = observations if "date" in observations.columns else with_date(observations)
    parallelism = rows.sparkSession.sparkContext.defaultParallelism
    ranges = max(rows.rdd.getNumPartitions(), parallelism)
    return rows.repartitionByRange(ranges, *OBSERVATION_PARTITIONS, "cml_id", "time").sortWithinPartitions(
        *OBSERVATION_PARTITIONS, "cml_id", F.desc("time")
    )


def write_observations(observations: DataFrame, path: str, mode: str = "append", codec: str = "snappy", bulk: bool = False) -> None:
    versions.write((bulk_clustered if bulk else clustered)(observations), path, OBSERVATION_PARTITIONS, mode, codec)


def replace_partitions(df: DataFrame, path: str, partitions: list[str], codec: str = "snappy", notes: dict[str, str] | None = None) -> None:
    """Put ``df`` in the place of the partitions that it has rows for.  ``df`` may
    read from ``path``."""
    versions.write(df.hint("rebalance", *partitions), path, partitions, "replace", codec, notes)


def replace_observations(df: DataFrame, path: str, codec: str = "snappy", bulk: bool = False, same_rows: bool = False) -> None:
    """``replace_partitions`` that keeps the order inside the files."""
    versions.write((bulk_clustered if bulk else clustered)(df), path, OBSERVATION_PARTITIONS, "replace", codec, same_rows=same_rows)


def uncompacted(spark: SparkSession, path: str, before: str) -> list[versions.Folder]:
    """Folders of the days before ``before`` in whose partition a file is not in the
    compact codec.  The codec is part of Spark's file names, so only names are listed."""
    old = [f for f in versions.current(spark, path).folders if f.values()["date"] < before]
    if not old:
        return []
    files = spark.read.format("binaryFile").option("basePath", f"{path}/parts").option("pathGlobFilter", "*.parquet")
    columns = "path string, modificationTime timestamp, length bigint, content binary, user_id string, date string"
    names = files.schema(columns).load([f"{path}/parts/{f.path}" for f in old])
    loose = names.where(~F.col("_metadata.file_name").endswith(f".{COMPACT_CODEC}.parquet")).select(*OBSERVATION_PARTITIONS).distinct()
    pending = {tuple("__HIVE_DEFAULT_PARTITION__" if v is None else v for v in r) for r in loose.collect()}  # tenants and days
    return [f for f in old if tuple(f.values()[c] for c in OBSERVATION_PARTITIONS) in pending]


def compact(spark: SparkSession, path: str, as_of, older_than_days: int = 7) -> None:
    """Rewrite days older than a week into few, better compressed files.  Days
    that are compact already are left alone."""
    limit = as_datetime(as_of).date() - timedelta(days=older_than_days)
    pending = uncompacted(spark, path, limit.isoformat())
    if pending:
        rows = versions.read_folders(spark, path, pending)
        replace_observations(rows, path, codec=COMPACT_CODEC, bulk=True, same_rows=True)


def read_range(spark: SparkSession, path: str, start=None, end=None, column: str = "time", schema=None) -> DataFrame:
    """``within`` of a table; with its schema also of one that is not written yet.
    Only the folders of the range are listed."""
    return within(versions.read(spark, path, schema, days_between(start, end)), start, end, column)


def within(rows: DataFrame, start=None, end=None, column: str = "time") -> DataFrame:
    """Rows of a time range, both ends inclusive, with the matching predicate on
    the ``date`` folders: a filter on time alone would list and open all days."""
    kind = rows.schema[column].dataType
    if start is not None:
        t = as_datetime(start)
        rows = rows.where((F.col("date") >= F.lit(t.date().isoformat()).cast("date")) & (F.col(column) >= F.lit(str(t)).cast(kind)))
    if end is not None:
        t = as_datetime(end)
        rows = rows.where((F.col("date") <= F.lit(t.date().isoformat()).cast("date")) & (F.col(column) <= F.lit(str(t)).cast(kind)))
    return rows
