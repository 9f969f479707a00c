"""Files to tables: parse, judge each file, write, audit, quarantine.

A batch is judged file by file.  A file that cannot be used goes to quarantine
with a reason and the others proceed.  Every write is idempotent, so a batch
that failed half-way is simply run again.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fadeline.functions.identity import stored_sublink
from fadeline.functions.times import as_datetime
from fadeline.operators import validate
from fadeline.operators.raw import load_summary
from fadeline.plans.store import Store
from fadeline.session import cache_scope, keep, staged
from fadeline.sources import archive, delimited, json_records
from fadeline.sources.formats import Format
from fadeline.sources.inventory import UNKNOWN_TIME, inventory
from fadeline.sources.names import file_kind

logger = logging.getLogger(__name__)

FILE_KEY = ["file_path", "filename", "file_modified"]


@dataclass(frozen=True)
class Job:
    """Where files come from and whose they are.

    ``row_policy`` says what a row without time, link or sublink does: ``file``
    quarantines its file, ``drop`` quarantines only the row.  With
    ``warn_missing`` a batch warns of sublinks that have no metadata.
    """

    store: Store
    fmt: Format
    user_id: str
    field_map: dict[str, dict[str, str]] = field(default_factory=dict)
    row_policy: str = "file"
    warn_missing: bool = False

    def __post_init__(self):
        if self.row_policy not in ("file", "drop"):
            raise ValueError(f"row_policy must be 'file' or 'drop', not {self.row_policy!r}")


def _timestamp(as_of) -> Column:
    return F.lit(as_datetime(as_of).isoformat(sep=" ")).cast("timestamp")


def _judge(rows: DataFrame, files: DataFrame, required: list[str], row_policy: str) -> DataFrame:
    """Verdict per file: header error, no rows, or a broken row."""
    broken = validate.row_reason(required)
    counts = rows.groupBy("file_path").agg(
        F.count("line_no").alias("rows_read"),
        F.min("header_error").alias("header_error"),
        F.min(F.when(F.col("line_no").isNotNull(), broken)).alias("broken"),
        F.count_if(F.col("line_no").isNotNull() & broken.isNull()).alias("rows_good"),
    )
    reason = F.coalesce(
        "header_error",
        F.when(F.coalesce("rows_read", F.lit(0)) == 0, F.lit("Empty file")),
        F.when(F.lit(row_policy == "file") | (F.col("rows_good") == 0), F.col("broken")),
    )
    joined = files.join(counts, "file_path", "left")
    return joined.select(*FILE_KEY, F.coalesce("rows_read", F.lit(0)).alias("rows_read"), "rows_good", reason.alias("reason"))


def _judge_links(rows: DataFrame, files: DataFrame) -> DataFrame:
    checks = [validate.coordinates_valid(c) for c in validate.RANGES]
    wrong = F.coalesce(*[F.when(~ok, F.lit(f"{c} out of range or incomplete")) for c, ok in zip(validate.RANGES, checks)])
    broken = validate.row_reason(["cml_id", "sublink_id"])
    counts = rows.groupBy("file_path").agg(
        F.count("line_no").alias("rows_read"),
        F.min("header_error").alias("header_error"),
        F.min(broken).alias("broken"),
        wrong.alias("wrong"),
    )
    joined = files.join(counts, "file_path", "left")
    empty = F.when(F.coalesce("rows_read", F.lit(0)) == 0, F.lit("Empty file"))
    reason = F.coalesce("header_error", empty, "broken", "wrong")
    count = F.coalesce("rows_read", F.lit(0))
    return joined.select(*FILE_KEY, count.alias("rows_read"), count.alias("rows_good"), reason.alias("reason"))


def _log_rows(job: Job, verdicts: DataFrame, as_of) -> DataFrame:
    good = F.col("reason").isNull()
    return verdicts.select(
        F.lit(job.user_id).alias("user_id"),
        "filename",
        F.when(good, "archived").otherwise("quarantined").alias("status"),
        F.when(good, F.col("rows_good")).cast("bigint").alias("rows_written"),
        F.col("reason").alias("error_message"),
        _timestamp(as_of).alias("processed_at"),
        F.col("rows_read").cast("bigint").alias("rows_read"),
        "file_path",
        "file_modified",
    )


def _quarantine(job: Job, verdicts: DataFrame, lines: DataFrame, as_of) -> None:
    """Raw lines of the bad files with reason, time and original path."""
    bad = verdicts.where("reason IS NOT NULL").select("file_path", "filename", "file_modified", "reason")
    kept = bad.join(lines.select("file_path", "value"), "file_path", "left")
    kept.select(
        F.lit(job.user_id).alias("user_id"), "file_path", "filename", "file_modified", "reason", F.col("value").alias("line"),
        _timestamp(as_of).alias("quarantined_at"), F.to_date(_timestamp(as_of)).alias("date"),
    ).withColumn("file_key", _file_key()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "user_id", "date", "file_key"
    ).parquet(job.store.path("quarantine"))


def _archive(job: Job, verdicts: DataFrame, lines: DataFrame, as_of) -> None:
    """Lines of the good files, compressed, under tenant, processing date and file.
    A file is told by its path and time: files of one name from other tenants or
    folders do not replace one another, and a batch that is run again does."""
    good = verdicts.where("reason IS NULL").select("file_path", "file_modified")
    rows = lines.select("file_path", "filename", "value").join(good, "file_path").select(
        "value", F.lit(job.user_id).alias("user_id"), F.to_date(_timestamp(as_of)).alias("processing_date"), "filename", _file_key().alias("file_key")
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(
        "user_id", "processing_date", "filename", "file_key"
    ).text(job.store.path("archive"))


def _file_key() -> Column:
    return F.hex(F.xxhash64("file_path", "file_modified"))


def _arrival() -> Column:
    """Order of arrival inside a batch: by file name, then by place in the file."""
    return F.struct("filename", "file_path", "block_start", "line_no")


def _write_raw(job: Job, rows: DataFrame, verdicts: DataFrame, as_of, merge_levels: bool) -> None:
    """Rows of the good files, then the statistics of the days and links they touch."""
    good = staged(verdicts.where("reason IS NULL").select("file_path"))
    if good.isEmpty():
        return
    usable = rows.where(F.col("line_no").isNotNull() & validate.row_reason().isNull())
    kept = usable.join(good, "file_path", "left_semi").withColumns({"seq": _arrival(), "user_id": F.lit(job.user_id)})
    if merge_levels:
        job.store.fill_nulls(kept)
    else:
        job.store.append_first_wins(kept)
    job.store.refresh_daily_stats()
    job.store.refresh_lifetime_stats(as_of, kept.select("user_id", "cml_id"))


@cache_scope()
def process_lines(job: Job, lines: DataFrame, files: DataFrame, as_of) -> None:
    """One batch of delimited files: metadata first, then data.

    ``lines`` comes from ``delimited``; ``files`` lists all files of the batch.    """
    kind = file_kind(F.col("filename"), job.fmt)
    files = files.select(*FILE_KEY).withColumn("kind", kind)
    lines = lines.withColumn("kind", kind)

    kinds = {row["kind"] for row in files.select("kind").distinct().collect()}
    verdicts, raw, raw_verdicts = [], None, None

    if "metadata" in kinds:
        links = keep(delimited.metadata_rows(lines.where("kind = 'metadata'"), job.fmt))
        judged = staged(_judge_links(links, files.where("kind = 'metadata'")))
        verdicts.append(judged)
        good = staged(judged.where("reason IS NULL").select("file_path"))
        if not good.isEmpty():
            tagged = links.join(good, "file_path", "left_semi").withColumns({"seq": _arrival(), "user_id": F.lit(job.user_id)})
            job.store.upsert_links(tagged)

    if "rawdata" in kinds:
        parsed = delimited.raw_rows(lines.where("kind = 'rawdata'"), job.fmt)
        raw = keep(parsed.withColumn("sublink_id", stored_sublink(F.col("sublink_id"))))
        raw_verdicts = staged(_judge(raw, files.where("kind = 'rawdata'"), ["time", "cml_id", "sublink_id"], job.row_policy))
        verdicts.append(raw_verdicts)
        _write_raw(job, raw, raw_verdicts, as_of, merge_levels=False)
        if job.warn_missing:
            _warn_missing(job, raw)

    verdicts.append(files.where("kind = 'unsupported'").select(
        *FILE_KEY, F.lit(0).cast("bigint").alias("rows_read"), F.lit(0).cast("bigint").alias("rows_good"),
        F.concat(F.lit("Unsupported file type: "), "filename").alias("reason"),
    ))
    every = reduce(DataFrame.unionByName, verdicts)
    if job.row_policy == "drop" and raw is not None:
        _quarantine_rows(job, raw, raw_verdicts, as_of)
    finish(job, every, lines, as_of)


def _warn_missing(job: Job, raw: DataFrame) -> None:
    """Data without metadata is written all the same, with a warning."""
    tagged = raw.where("line_no IS NOT NULL").withColumn("user_id", F.lit(job.user_id))
    sample = validate.missing_reference_warning(tagged, job.store.links()).collect()
    if sample:
        pairs = [(r["cml_id"], r["sublink_id"]) for r in sample]
        logger.warning("Missing metadata for %d (cml_id, sublink_id) pairs; sample: %s", sample[0]["missing_pairs"], pairs)


def _quarantine_rows(job: Job, raw: DataFrame, verdicts: DataFrame, as_of) -> None:
    """Single broken rows of files that are otherwise good."""
    broken = raw.where(validate.row_reason().isNotNull()).join(verdicts.where("reason IS NULL").select("file_path"), "file_path", "left_semi")
    broken.select(
        F.lit(job.user_id).alias("user_id"), "file_path", "filename", "file_modified", validate.row_reason().alias("reason"),
        F.to_json(F.struct("time", "cml_id", "sublink_id", "tsl", "rsl")).alias("line"),
        _timestamp(as_of).alias("quarantined_at"), F.to_date(_timestamp(as_of)).alias("date"),
    ).withColumn("file_key", _file_key()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "user_id", "date", "file_key"
    ).parquet(job.store.path("quarantine"))


def finish(job: Job, verdicts: DataFrame, lines: DataFrame, as_of) -> None:
    """Archive, quarantine, log.  The log comes last: a file is logged only when
    all else about it has been written.  A log that cannot be written stops
    nothing; its files are taken for new next time, and loading them again
    changes nothing."""
    _archive(job, verdicts, lines, as_of)
    _quarantine(job, verdicts, lines, as_of)
    try:
        job.store.append_log(_log_rows(job, verdicts, as_of))
    except Exception:
        logger.exception("The file log could not be written; the data of the batch is stored")


@cache_scope()
def process_json(job: Job, files: DataFrame, as_of) -> None:
    """One batch of JSON files.  Their levels come in separate files, so rows of
    one key complete one another instead of the first one winning."""
    parsed = json_records.raw_rows(files, job.field_map).withColumn("sublink_id", stored_sublink(F.col("sublink_id")))
    raw = keep(parsed)
    absent = json_records.absent_fields(raw).withColumnRenamed("header_error", "absent_error")
    verdicts = _judge(raw, files.select(*FILE_KEY), ["time", "cml_id", "sublink_id"], job.row_policy)
    verdicts = verdicts.join(absent, "file_path", "left").withColumn("reason", F.coalesce("absent_error", "reason")).drop("absent_error")
    verdicts = staged(verdicts)
    _write_raw(job, raw, verdicts, as_of, merge_levels=True)
    finish(job, verdicts, files, as_of)


def unlogged(store: Store, files: DataFrame) -> DataFrame:
    """Files of a listing that the log does not know at their present time."""
    return files.join(store.file_log().select("file_path", "file_modified"), ["file_path", "file_modified"], "left_anti")


def ingest_folder(spark: SparkSession, job: Job, path: str, as_of) -> None:
    """All new files of a folder in one batch: metadata, data, then JSON."""
    for glob in ("*.csv", "*.json"):
        _ingest_new(spark, job, path, glob, as_of)


def _ingest_new(spark: SparkSession, job: Job, path: str, glob: str, as_of) -> None:
    new = staged(unlogged(job.store, inventory(spark, path, glob)).select(*FILE_KEY))
    if new.isEmpty():
        return
    changed = F.when(F.col("file_modified") > F.lit(UNKNOWN_TIME), F.col("file_modified"))
    since = new.agg(F.min(changed)).first()[0]
    key = new.select("file_path", "file_modified")
    if glob == "*.json":
        files = json_records.read_files(spark, path, glob, since).join(key, ["file_path", "file_modified"], "left_semi")
        process_json(job, _with_empty(files, new), as_of)
    else:
        lines = delimited.text_lines(spark, path, job.fmt, glob, since).join(key, ["file_path", "file_modified"], "left_semi")
        process_lines(job, lines, new, as_of)


def _with_empty(files: DataFrame, listed: DataFrame) -> DataFrame:
    """A file without a byte gives no row in a text source; it is listed all the same."""
    empty = listed.where(F.col("file_modified") == F.lit(UNKNOWN_TIME).cast("timestamp"))
    none = empty.select(F.lit(None).cast("string").alias("value"), *FILE_KEY)
    return files.select("value", *FILE_KEY).unionByName(none)


def load_archive(spark: SparkSession, store: Store, data_path: str, metadata_path: str, user_id: str, as_of, replace_all: bool = False) -> DataFrame:
    """Bulk load of an archive: metadata that is not stored yet, all data rows
    (a repeated key is an error), partials, lifetime statistics and the whole
    rollup.  ``replace_all`` empties both tables first.  Returns the summary."""
    links = archive.read_metadata(spark, metadata_path, user_id)
    rows = archive.read_raw(spark, data_path, user_id)
    if replace_all:
        store.load_unique(rows, mode="overwrite")
        store.replace_links(links)
    else:
        store.insert_links(links)
        store.load_unique(rows)
    store.refresh_all_stats(as_of)
    if replace_all:
        store.refresh_windowed_stats(as_of)
    store.refresh_full_rollup()
    return load_summary(store.observations())
