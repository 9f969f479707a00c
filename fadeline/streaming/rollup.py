"""Streams of observations: hourly rollup, sliding statistics and duplicate removal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fadeline.functions.times import as_datetime, time_bucket
from fadeline.operators import layout, stats, versions
from fadeline.operators.rollup import ROLLUP_KEYS, hourly_rollup
from fadeline.operators.upsert import new_rows
from fadeline.schemas import OBSERVATION_KEY
from fadeline.session import cache_scope, keep

LEVELS = ("rsl", "tsl")
STATE = (
    "bucket timestamp, user_id string, cml_id string, sublink_id string, "
    + ", ".join(f"{x}_min double, {x}_max double, {x}_sum double, {x}_n bigint" for x in LEVELS)
    + ", date date"
)
PANES = (
    "minute timestamp, user_id string, cml_id string, sublink_id string, n bigint, n_valid bigint, sum_rsl double, m2 double, "
    "min_rsl double, max_rsl double, last_time timestamp, last_rsl double, date date"
)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _mergeable(rows: DataFrame) -> DataFrame:
    """Hourly aggregates that can be added up."""
    return rows.groupBy(time_bucket("time").alias("bucket"), "user_id", "cml_id", "sublink_id").agg(
        *[
            f.alias(f"{x}_{name}")
            for x in LEVELS
            for name, f in (
                ("min", F.min(x).cast("double")),
                ("max", F.max(x).cast("double")),
                ("sum", F.sum(F.col(x).cast("double"))),
                ("n", F.count(x)),
            )
        ]
    )


def _merged(parts: DataFrame) -> DataFrame:
    folds = {"min": F.min, "max": F.max, "sum": F.sum, "n": F.sum}
    columns = [f(f"{x}_{name}").alias(f"{x}_{name}") for x in LEVELS for name, f in folds.items()]
    return parts.groupBy(*ROLLUP_KEYS, "date").agg(*columns)


def start_folding(
    stream: DataFrame, path: str, checkpoint: str, schema: str, made: Callable[[DataFrame], DataFrame],
    merged: Callable[[DataFrame], DataFrame], time: str, interval: str | None = None,
) -> StreamingQuery:
    """Keep a table of mergeable aggregates of a stream, by day.

    A micro-batch is folded into the days it touches, whatever the order of the
    files, so late rows are never lost and the raw rows are not read again.  The
    table notes the query and its last batch in the same moment as the rows: a batch
    that is run again after a failure is either in it as a whole or not at all.
    Path and checkpoint belong together, since the batch numbers are those of the
    checkpoint: a query with another checkpoint stops instead of taking new rows for
    old ones.  No folder but those of the days touched is opened.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with cache_scope():
            spark = batch.sparkSession
            query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
            known = versions.current(spark, path)
            if known.notes.get("query", query) != query:
                raise ValueError(f"{path} was made by another query: it needs that query's checkpoint")
            if int(known.notes.get("batch", -1)) >= batch_id:
                return
            typed = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")]
            fresh = keep(layout.with_date(made(batch), time).select(*typed))
            days = {str(r["date"]) for r in fresh.select("date").distinct().collect()}
            stored = versions.read_folders(spark, path, [f for f in known.folders if f.values()["date"] in days], schema)
            rows = merged(stored.unionByName(fresh)).select(_names(schema))
            layout.replace_partitions(rows, path, ["date"], notes={"query": query, "batch": str(batch_id)})

    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def start_rollup(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the hourly rollup of a stream, see ``start_folding``."""
    return start_folding(stream, path, checkpoint, STATE, _mergeable, _merged, "bucket", interval)


def start_panes(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Keep the minutes of which sliding windows are made, see ``start_folding``.
    Rows of the stream are unique."""
    fold = lambda parts: stats.folded(parts, ["minute", "date"])
    return start_folding(stream, path, checkpoint, PANES, stats.panes, fold, "minute", interval)


def windowed_stats(spark, path: str, links: DataFrame, as_of) -> DataFrame:
    """The statistics of the last 6 h and 1 h from the panes of a stream, for a whole
    minute.  Windows are folded from the panes of their days' folders; last values
    come from all panes, of which three columns are read."""
    since = as_datetime(as_of) - timedelta(hours=6)
    recent = layout.within(versions.read(spark, path, PANES, layout.days_between(since)), since, column="minute")
    return stats.windowed_from_panes(recent, links, as_of, stats.last_of_partials(versions.read(spark, path, PANES)))


def read_rollup(spark, path: str) -> DataFrame:
    """The rollup from its mergeable form."""
    parts = versions.read(spark, path, STATE)
    return parts.select(
        *ROLLUP_KEYS,
        *[
            c
            for x in LEVELS
            for c in (f"{x}_min", f"{x}_max", (F.col(f"{x}_sum") / F.when(F.col(f"{x}_n") > 0, F.col(f"{x}_n"))).alias(f"{x}_avg"))
        ],
    )


def windowed_rollup(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """The rollup as a watermarked window, for live input in time order.  The
    watermark drops rows later than ``lateness`` behind the newest time seen; a
    stream that may have any uses ``start_rollup``, which keeps all rows."""
    return hourly_rollup(stream.withWatermark("time", lateness))


def start_first_wins(stream: DataFrame, path: str, checkpoint: str, order: str, key: list[str] | None = None, interval: str | None = None) -> StreamingQuery:
    """Append the rows of a stream whose key is not in the table yet, however late.

    The table itself is the state: each batch looks up the days it touches, so no
    row is dropped for its age, and a batch that is run again appends nothing.
    """
    own_key = key or OBSERVATION_KEY

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        with cache_scope():
            spark = batch.sparkSession
            fresh = keep(layout.with_date(batch))
            schema = layout.with_date(batch).schema
            stored = layout.of_days(versions.read(spark, path, schema), fresh)
            layout.write_observations(new_rows(stored, fresh.drop("date"), own_key, order), path)

    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def start_append(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream to a table partitioned by tenant and day."""
    writer = (
        layout.with_date(stream)
        .writeStream.format("parquet")
        .partitionBy(*layout.OBSERVATION_PARTITIONS)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
