"""Incremental loading: unseen files, window planning, the window ledger, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.functions.times import as_datetime


def unseen_files(inventory: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose name and modification time are not the ones last seen.

    The ledger gets a row (source, filename, mtime, seen_at) only after a file
    has been taken over, so failed files come up again."""
    key = ["source", "filename", "mtime"]
    last_seen = ledger.groupBy("source", "filename").agg(F.max_by("mtime", "seen_at").alias("mtime"))
    return inventory.join(last_seen, key, "left_anti")


def backfill_windows(sources: DataFrame, chunk_hours: int) -> DataFrame:
    """All windows of each source from ``cursor`` (or ``backfill_start``) up to
    ``backfill_end``; none when the cursor has reached the end."""
    begin = F.coalesce("cursor", "backfill_start") if "cursor" in sources.columns else F.col("backfill_start")
    chunk = F.make_dt_interval(hours=F.lit(chunk_hours))
    starts = sources.where(begin < F.col("backfill_end")).select(
        "source", "backfill_end", F.explode(F.sequence(begin, F.col("backfill_end"), chunk)).alias("window_start")
    )
    return starts.where("window_start < backfill_end").select(
        "source", "window_start", F.least(F.col("window_start") + chunk, F.col("backfill_end")).alias("window_end")
    )


def continuous_window(sources: DataFrame, as_of, chunk_hours: int, overlap_seconds: int) -> DataFrame:
    """The next window of each source: from ``cursor`` minus the overlap to
    ``cursor`` plus the chunk, never beyond now; without a cursor the last
    chunk.  Sources with an empty window are left out."""
    now = F.lit(as_datetime(as_of).isoformat(sep=" ")).cast(sources.schema["cursor"].dataType)
    chunk, overlap = F.make_dt_interval(hours=F.lit(chunk_hours)), F.make_dt_interval(secs=F.lit(overlap_seconds))
    cursor = F.col("cursor")
    windows = sources.select(
        "source",
        F.when(cursor.isNull(), now - chunk).otherwise(cursor - overlap).alias("window_start"),
        F.when(cursor.isNull(), now).otherwise(F.least(cursor + chunk, now)).alias("window_end"),
    )
    return windows.where("window_end > window_start")


def with_variants(windows: DataFrame, variants: list[str]) -> DataFrame:
    """Each window once per request variant."""
    return windows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))


def open_windows(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned windows that are not done: failed ones come up again, empty ones
    count as done."""
    key = ["source", "window_start", "variant"] if "variant" in planned.columns else ["source", "window_start"]
    done = ledger.where(F.col("status").isin("done", "empty")).select(*key)
    return planned.join(done, key, "left_anti")


def cursors(ledger: DataFrame) -> DataFrame:
    """Cursor per source: the latest window end, whatever became of the window."""
    return ledger.groupBy("source").agg(F.max("window_end").alias("cursor"))


def _page_lists(text: Column, results_key: str | None) -> tuple[Column, Column]:
    """Records of a page, and the number it announces, from one parse."""
    keys = [results_key] if results_key else ["results", "data"]
    fields = ", ".join(f"`{k}` array<map<string,string>>" for k in keys)
    is_list = text.startswith("[")
    listed = F.from_json(F.when(is_list, text), "array<map<string,string>>")
    wrapped = F.from_json(F.when(~is_list, text), f"`count` bigint, {fields}")
    return F.coalesce(listed, *[wrapped[k] for k in keys]), wrapped["count"]


def page_records(pages: DataFrame, body: str = "body", results_key: str | None = None) -> DataFrame:
    """Records of landed result pages.

    A page is a list, or an object with the list under ``results_key``, or
    under ``results``, or under ``data``.
    """
    records, _ = _page_lists(F.trim(F.col(body)), results_key)
    keep = [c for c in pages.columns if c != body]
    return pages.select(*keep, F.explode(records).alias("record"))


def page_completeness(pages: DataFrame, by: list[str], body: str = "body", results_key: str | None = None) -> DataFrame:
    """Records got and announced per request; complete when nothing is missing."""
    records, announced = _page_lists(F.trim(F.col(body)), results_key)
    sums = pages.select(*by, F.coalesce(F.array_size(records), F.lit(0)).alias("got"), announced.alias("announced"))
    return (
        sums.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("pages"), F.sum("got").alias("records"), F.max("announced").alias("announced"))
        .withColumn("complete", F.col("announced").isNull() | (F.col("records") >= F.col("announced")))
    )
