"""Rules on files and rows, and checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.schemas import LINK_COLUMNS, RAW_COLUMNS
from fadeline.session import staged

# The required columns of each kind and the valid ranges.
REQUIRED = {"rawdata": RAW_COLUMNS, "metadata": LINK_COLUMNS}
RANGES = {
    "site_0_lon": (-180, 180),
    "site_1_lon": (-180, 180),
    "site_0_lat": (-90, 90),
    "site_1_lat": (-90, 90),
}


def missing_columns(df: DataFrame, kind: str) -> list[str]:
    if kind not in REQUIRED:
        raise ValueError(f"unknown kind {kind!r}")
    return [c for c in REQUIRED[kind] if c not in df.columns]


def coordinates_valid(column: str) -> Column:
    """True if all values lie in range or all are null; some nulls fail."""
    low, high = RANGES[column]
    x = F.col(column)
    return (F.count(x) == 0) | F.bool_and(F.coalesce(x.between(low, high), F.lit(False)))


def coordinate_check(links: DataFrame, file: str = "filename") -> DataFrame:
    """Per metadata file: is it valid, and which coordinate fails first."""
    checks = links.groupBy(file).agg(*[coordinates_valid(c).alias(c) for c in RANGES])
    failed = F.coalesce(*[F.when(~F.col(c), F.lit(f"{c} out of range or incomplete")) for c in RANGES])
    return checks.select(file, failed.isNull().alias("valid"), failed.alias("reason"))


def validate_frame(df: DataFrame, kind: str) -> DataFrame:
    """One row ``valid``: the verdict on a frame taken as one file.  An unknown
    kind or a missing column is invalid without reading the data."""
    spark = df.sparkSession
    if kind not in REQUIRED or missing_columns(df, kind):
        return spark.range(1).select(F.lit(False).alias("valid"))
    not_empty = F.count(F.lit(1)) > 0
    if kind == "rawdata":
        rule = not_empty & ~F.coalesce(F.bool_or(F.col("time").isNull()), F.lit(False))
    else:
        rule = not_empty
        for column in RANGES:
            rule = rule & F.coalesce(coordinates_valid(column), F.lit(True))
    return df.agg(rule.alias("valid"))


def row_reason(row_columns=("time", "cml_id", "sublink_id")) -> Column:
    """Why a row breaks a NOT NULL constraint, or null."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in row_columns])


def status_valid(status: Column) -> Column:
    return status.isin("archived", "quarantined")


def file_verdicts(rows: DataFrame, files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Verdict per raw file.  ``files`` lists every file, because a file without
    rows shows up nowhere else; it may bring an ``error`` found earlier."""
    by = by or ["filename"]
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("time").isNull()).alias("null_times"),
        F.min(row_reason()).alias("null_reason"),
    )
    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    joined = files.join(counts, by, "left")
    reason = F.coalesce(
        known,
        F.when(F.coalesce("rows_read", F.lit(0)) == 0, F.lit("Empty file")),
        F.col("null_reason"),
    )
    return joined.select(
        *files.columns[: len(files.columns)],
        F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
        F.coalesce("null_times", F.lit(0)).alias("null_times"),
        F.when(reason.isNull(), "archived").otherwise("quarantined").alias("status"),
        reason.alias("reason"),
    )


def missing_references(observations: DataFrame, links: DataFrame) -> DataFrame:
    """Sublinks that send data but have no metadata with the same tenant.  A key
    with a null has none.

    Both sides are folded by one aggregate: the links, of which there may be
    millions in a small file, are never one table in the memory of a task."""
    key = ["user_id", "cml_id", "sublink_id"]
    sent = observations.select(*key, F.lit(False).alias("known"))
    known = links.select(*key, F.lit(True).alias("known")).dropna(subset=key)
    folded = sent.unionByName(known).groupBy(*key).agg(F.bool_or("known").alias("known"))
    return folded.where(~F.col("known")).select(*key).orderBy(*key)


def missing_reference_warning(observations: DataFrame, links: DataFrame, sample: int = 10) -> DataFrame:
    """Number of sublinks without metadata, and the first few of them."""
    missing = staged(missing_references(observations, links))
    count = missing.agg(F.count(F.lit(1)).alias("n")).scalar()
    return missing.orderBy(*missing.columns).limit(sample).withColumn("missing_pairs", count)


def orphan_count(observations: DataFrame, links: DataFrame) -> DataFrame:
    """Observations without metadata in any tenant."""
    key = ["cml_id", "sublink_id"]
    counted = observations.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    orphans = counted.join(links.select(*key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


def orphan_count_left_join(observations: DataFrame, links: DataFrame) -> DataFrame:
    """The same count as a left join with a null test."""
    key = ["cml_id", "sublink_id"]
    counted = observations.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    known = links.select(*key).distinct().withColumn("known", F.lit(True))
    joined = counted.join(known, key, "left").where(F.col("known").isNull())
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
