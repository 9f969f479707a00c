"""Folders watched for new files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fadeline.plans import ingest
from fadeline.session import cache_scope, keep
from fadeline.sources import delimited, json_records
from fadeline.sources.inventory import inventory

FILES_PER_BATCH = 500


def _now(as_of):
    return as_of or datetime.now(timezone.utc).replace(tzinfo=None)


def _source(spark: SparkSession, path: str, glob: str, whole: bool, files_per_batch: int, clean: str, archive_dir: str | None) -> DataFrame:
    reader = (
        spark.readStream.option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("cleanSource", clean)
    )
    if archive_dir:
        reader = reader.option("sourceArchiveDir", archive_dir)
    return reader.text(path, wholetext=whole)


def _start(lines: DataFrame, each_batch, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = lines.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def watch_delimited(
    spark: SparkSession, job: ingest.Job, path: str, checkpoint: str, interval: str | None = None, as_of=None,
    files_per_batch: int = FILES_PER_BATCH, clean: str = "off", archive_dir: str | None = None,
) -> StreamingQuery:
    """Process CSV files as they arrive; without an interval, the backlog and
    stop.  ``clean`` says what becomes of a read file: off, delete or archive."""
    source = _source(spark, path, "*.csv", job.fmt.whole_files, files_per_batch, clean, archive_dir)
    lines = delimited.with_file(source, job.fmt)

    def each_batch(batch: DataFrame, _batch_id: int) -> None:
        with cache_scope():
            lines = keep(delimited.number_lines(batch))
            listed = lines.select(*ingest.FILE_KEY).distinct()
            ingest.process_lines(job, lines, listed, _now(as_of))

    return _start(lines, each_batch, checkpoint, interval)


def watch_json(
    spark: SparkSession, job: ingest.Job, path: str, checkpoint: str, interval: str | None = None, as_of=None,
    files_per_batch: int = FILES_PER_BATCH, clean: str = "off", archive_dir: str | None = None,
) -> StreamingQuery:
    """The same for JSON files."""
    files = json_records.with_file(_source(spark, path, "*.json", True, files_per_batch, clean, archive_dir))

    def each_batch(batch: DataFrame, _batch_id: int) -> None:
        with cache_scope():
            ingest.process_json(job, keep(batch), _now(as_of))

    return _start(files, each_batch, checkpoint, interval)


def log_empty_files(spark: SparkSession, job: ingest.Job, path: str, as_of=None) -> None:
    """A file without a byte never reaches a text stream: quarantine it from the
    listing.  Run it now and then next to the streams."""
    listed = inventory(spark, path).where("size_bytes = 0")
    new = ingest.unlogged(job.store, listed).select(
        *ingest.FILE_KEY, F.lit(0).cast("bigint").alias("rows_read"), F.lit(0).cast("bigint").alias("rows_good"), F.lit("Empty file").alias("reason")
    )
    lines = new.select("file_path", F.lit(None).cast("string").alias("value"), "filename")
    ingest.finish(job, new, lines, _now(as_of))


def refresh_statistics(job: ingest.Job, as_of=None) -> None:
    """The windowed statistics of all links: run at the start and every minute
    by whatever schedules jobs."""
    job.store.refresh_windowed_stats(_now(as_of))
