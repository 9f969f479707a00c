"""Listing of files without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.sources.names import plain_name, size_mb

UNKNOWN_TIME = "1970-01-01 00:00:00"


def inventory(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """Every file that matches ``glob``; folders are not listed.  The content
    column is never asked for, so no file is opened.

    File sources skip files without a byte; those come from the list of input
    files, which Spark holds on the driver anyway, with an unknown time.
    """
    source = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = source.select(
        F.col("_metadata.file_path").alias("file_path"),
        plain_name(F.col("_metadata.file_name")).alias("filename"),
        F.col("_metadata.file_modification_time").alias("file_modified"),
        F.col("_metadata.file_size").alias("size_bytes"),
    )
    listed = spark.createDataFrame([(p,) for p in source.inputFiles()], "file_path string").select(
        F.regexp_replace("file_path", "^file:/+", "file:/").alias("file_path")
    )
    empty = listed.join(files, "file_path", "left_anti").select(
        "file_path",
        plain_name(F.element_at(F.split("file_path", "/"), -1)).alias("filename"),
        F.lit(UNKNOWN_TIME).cast("timestamp").alias("file_modified"),
        F.lit(0).cast("bigint").alias("size_bytes"),
    )
    return files.unionByName(empty)


def file_listing(spark: SparkSession, path, glob: str = "*") -> DataFrame:
    """Name, size in MB and time, newest first, with the folder."""
    files = inventory(spark, path, glob)
    folder = F.element_at(F.split("file_path", "/"), -2)
    return files.select(
        folder.alias("folder"),
        "filename",
        size_mb(F.col("size_bytes")).alias("size_mb"),
        F.date_format("file_modified", "yyyy-MM-dd HH:mm:ss").alias("upload_time"),
    ).orderBy(F.desc("upload_time"), "filename")
