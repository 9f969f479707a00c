"""The tables on disk and the writes that keep their keys.

Every table is a ``versions`` table: a write takes effect as a whole.  What is derived
from observations notes the version of ``observations`` that it has taken in, in the
same moment as its rows; the next refresh reads only folders that came later.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fadeline.functions.times import as_datetime, in_range, time_bucket
from fadeline.operators import layout, rollup, stats, upsert, versions
from fadeline.operators.rollup import ROLLUP_KEYS
from fadeline.session import staged
from fadeline.schemas import (
    FILE_LOG,
    LIFETIME_COLUMNS,
    LINK,
    LINK_KEY,
    OBSERVATION,
    OBSERVATION_KEY,
    STATS_KEY,
    WINDOW_COLUMNS,
)

_DATE = T.StructField("date", T.DateType())
_PARTIALS = (
    "cml_id string, sublink_id string, n bigint, n_valid bigint, sum_rsl double, m2 double, min_rsl float, "
    "max_rsl float, last_time timestamp, last_rsl float, user_id string, date date"
)
_PANES = _PARTIALS.replace("n bigint, ", "minute timestamp, n bigint, ", 1)
_ROLLUP = (
    "bucket timestamp, user_id string, cml_id string, sublink_id string, rsl_min float, rsl_max float, rsl_avg double, "
    "tsl_min float, tsl_max float, tsl_avg double, date date"
)


def _stats_schema(columns: list[str]) -> str:
    kinds = [f"{c} {'bigint' if 'records' in c else 'double'}" for c in columns]
    return ", ".join(["cml_id string", *kinds, "last_rsl double", "last_update timestamp", "user_id string"])


_LIFETIME = _stats_schema(LIFETIME_COLUMNS)
_WINDOWED = _stats_schema(WINDOW_COLUMNS)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


class Store:
    """Tables below one root folder.

    ========================  ==========================================
    ``observations``          by user_id, date; sorted by link and time
    ``links``                 by user_id
    ``daily_stats``           mergeable partials of days, by user_id, date
    ``panes``                 mergeable partials of minutes, by user_id, date
    ``lifetime_stats``        by user_id
    ``windowed_stats``        by user_id
    ``rollup_1h``             by date; notes the time up to which it is complete
    ``file_log``              by date of the file's modification
    ``archive``               lines of good files, by user_id, date, file
    ``quarantine``            by user_id, date, file
    ========================  ==========================================
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema, only=None) -> DataFrame:
        return versions.read(self.spark, self.path(name), schema, only)

    def observations(self, start=None, end=None) -> DataFrame:
        """All observations, or those of a time range, both ends inclusive."""
        only = layout.days_between(start, end)
        return layout.within(self._read("observations", T.StructType([*OBSERVATION.fields, _DATE]), only), start, end)

    def links(self) -> DataFrame:
        return self._read("links", LINK)

    def daily_stats(self) -> DataFrame:
        return self._read("daily_stats", _PARTIALS)

    def link_stats(self) -> DataFrame:
        """One row per link.  Lifetime and windowed columns are written apart, so
        neither refresh touches the other's; the last value and the time of the
        update are those of the later one."""
        life, window = self._read("lifetime_stats", _LIFETIME), self._read("windowed_stats", _WINDOWED)
        joined = life.alias("l").join(window.alias("w"), STATS_KEY, "full_outer")
        window_newer = F.col("w.last_update").isNotNull() & (
            F.col("l.last_update").isNull() | (F.col("w.last_update") >= F.col("l.last_update"))
        )
        return joined.select(
            *STATS_KEY,
            *LIFETIME_COLUMNS,
            *WINDOW_COLUMNS,
            F.when(window_newer, F.col("w.last_rsl")).otherwise(F.col("l.last_rsl")).alias("last_rsl"),
            F.greatest("l.last_update", "w.last_update").alias("last_update"),
        )

    def rollup(self) -> DataFrame:
        return self._read("rollup_1h", _ROLLUP)

    def file_log(self) -> DataFrame:
        return self._read("file_log", T.StructType([T.StructField("id", T.LongType()), *FILE_LOG.fields, _DATE]))

    def _typed(self, rows: DataFrame) -> DataFrame:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION.fields], "seq")
        return layout.with_date(typed)

    def append_first_wins(self, rows: DataFrame) -> None:
        """Append the rows whose key is not stored yet.  Loading a batch twice
        changes nothing.  ``rows`` carries its arrival order in ``seq``."""
        typed = self._typed(rows)
        stored = layout.of_days(self.observations(), typed)
        fresh = upsert.new_rows(stored, typed, OBSERVATION_KEY, "seq").drop("seq")
        layout.write_observations(fresh, self.path("observations"))

    def fill_nulls(self, rows: DataFrame) -> None:
        """Merge rows so that they fill null levels of stored ones, and rewrite
        the days they touch."""
        typed = self._typed(rows)
        pairs = staged(typed.select("user_id", "date").distinct())
        place = typed.schema["seq"].dataType
        stored = layout.of_days(self.observations(), typed).join(pairs, ["user_id", "date"], "left_semi")
        rank = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("place", place)])
        old = stored.withColumn("seq", F.struct(F.lit(0).alias("batch"), F.lit(None).cast(place).alias("place")).cast(rank))
        new = typed.withColumn("seq", F.struct(F.lit(1).alias("batch"), F.col("seq").alias("place")).cast(rank))
        merged = upsert.fill_nulls(old.unionByName(new)).drop("seq")
        layout.replace_observations(merged, self.path("observations"))

    def load_unique(self, rows: DataFrame, mode: str = "append") -> None:
        """Bulk load; a repeated key is an error.  The rows are written once, their
        keys are checked in the files written, and only then do these count."""
        path = self.path("observations")
        typed = layout.with_date(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION.fields]))
        part = versions.prepare(layout.bulk_clustered(staged(typed)), path, layout.OBSERVATION_PARTITIONS)
        written = self.spark.read.schema(self.observations().schema).parquet(f"{path}/parts/{part}")
        checked = written.select(*OBSERVATION_KEY, "date")
        if mode == "append":
            checked = checked.unionByName(layout.of_days(self.observations(), written).select(*OBSERVATION_KEY, "date"))
        if upsert.has_repeated_keys(checked):
            raise ValueError("duplicate key in bulk load")
        versions.publish(self.spark, path, part, len(layout.OBSERVATION_PARTITIONS), mode)

    def _typed_links(self, rows: DataFrame) -> DataFrame:
        order = [c for c in rows.columns if c == "seq"]
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LINK.fields], *order)

    def _rewrite_links(self, merged: DataFrame, users: DataFrame) -> None:
        kept = merged.join(users, "user_id", "left_semi").select(*[f.name for f in LINK.fields])
        layout.replace_partitions(kept, self.path("links"), ["user_id"])

    def upsert_links(self, rows: DataFrame) -> None:
        """Last row of a link wins, all values replaced."""
        typed = self._typed_links(rows)
        merged = upsert.merge_last_wins(self.links(), upsert.last_wins(typed, LINK_KEY).withColumn("seq", F.lit(0).cast("bigint")))
        self._rewrite_links(merged, typed.select("user_id").distinct())

    def insert_links(self, rows: DataFrame) -> None:
        """Only links that are not stored yet."""
        typed = self._typed_links(rows)
        merged = upsert.insert_if_absent(self.links(), typed)
        self._rewrite_links(merged, typed.select("user_id").distinct())

    def replace_links(self, rows: DataFrame) -> None:
        """Only the given links, for all tenants."""
        typed = self._typed_links(rows)
        versions.write(typed, self.path("links"), ["user_id"], "overwrite")

    def refresh_all_stats(self, as_of) -> None:
        """Partials of every day and the lifetime columns of every link."""
        self._fold("daily_stats", _PARTIALS, ["date"], anew=True)
        self.refresh_lifetime_stats(as_of)

    def refresh_daily_stats(self) -> None:
        """Fold what came to the observations since the last refresh into the partials
        of its days.  Rows that were counted before are not read again."""
        self._fold("daily_stats", _PARTIALS, ["date"])

    def refresh_panes(self) -> None:
        """The same for the partials of minutes."""
        self._fold("panes", _PANES, ["minute", "date"])

    def _fold(self, name: str, schema: str, by: list[str], anew: bool = False) -> None:
        """Take the newer folders of ``observations`` into a table of partials.

        Folders that were added are folded into the stored partials of their days;
        those that took the place of others (null levels filled, rows corrected) give
        their days' partials anew.  The version that is taken in is noted with the rows,
        so a refresh that died is simply run again, and nothing is counted twice.
        """
        path, source = self.path(name), self.path("observations")
        observed, stored = versions.current(self.spark, source), versions.current(self.spark, path)
        through = int(stored.notes.get("observations", 0))
        anew = anew or through < observed.whole_since
        newer = [f for f in observed.folders if anew or f.version > through]
        notes = {"observations": str(observed.number)}
        if not newer and not anew:
            return
        schema_of_rows = T.StructType([*OBSERVATION.fields, _DATE])
        of = lambda folders: self._partials_of(versions.read_folders(self.spark, source, folders, schema_of_rows), by)
        columns = _names(schema)
        if anew:
            versions.write(of(newer).select(columns).hint("rebalance", "user_id", "date"), path, ["user_id", "date"], "overwrite", notes=notes)
            return
        rewritten = {f.partition for f in newer if f.rewritten}
        touched = {f.partition for f in newer}
        added = of([f for f in newer if f.partition not in rewritten])
        again = of([f for f in observed.folders if f.partition in rewritten])
        known = versions.read_folders(self.spark, path, [f for f in stored.folders if f.partition in touched - rewritten], schema)
        merged = stats.folded(known.select(columns).unionByName(added.select(columns)), by).select(columns)
        layout.replace_partitions(merged.unionByName(again.select(columns)), path, ["user_id", "date"], notes=notes)

    @staticmethod
    def _partials_of(rows: DataFrame, by: list[str]) -> DataFrame:
        return stats.partials(rows.withColumn("minute", time_bucket("time", stats.PANE)) if "minute" in by else rows, by)

    def refresh_lifetime_stats(self, as_of, ids: DataFrame | None = None) -> None:
        """Lifetime columns from the partials, for all links or those of ``ids``."""
        parts = self.daily_stats()
        if ids is None:
            self._write_stats(stats.merge_partials(parts), "lifetime_stats", _LIFETIME, as_of)
            return
        fresh = self._stamped_stats(stats.merge_partials(stats.only_links(parts, ids)), _LIFETIME, as_of)
        stored = self._read("lifetime_stats", _LIFETIME)
        users = fresh.select("user_id").distinct()
        others = stored.join(users, "user_id", "left_semi").join(fresh.select(*STATS_KEY), STATS_KEY, "left_anti")
        merged = others.select(_names(_LIFETIME)).unionByName(fresh)
        layout.replace_partitions(merged, self.path("lifetime_stats"), ["user_id"])

    def refresh_windowed_stats(self, as_of) -> None:
        """Windowed columns of every known link.  For a whole minute they come from the
        panes of the last six hours, else from the raw rows of the folders that hold
        them; older last values come from the partials of days."""
        now = as_datetime(as_of)
        since, last = now - timedelta(hours=6), stats.last_of_partials(self.daily_stats())
        if now.second or now.microsecond:
            windowed = stats.windowed_stats(self.observations(since), self.links(), as_of, last)
        else:
            self.refresh_panes()
            recent = layout.within(self._read("panes", _PANES, layout.days_between(since)), since, column="minute")
            windowed = stats.windowed_from_panes(recent, self.links(), as_of, last)
        self._write_stats(windowed, "windowed_stats", _WINDOWED, as_of)

    def _stamped_stats(self, rows: DataFrame, schema: str, as_of) -> DataFrame:
        stamp = F.lit(as_datetime(as_of).isoformat(sep=" ")).cast("timestamp")
        stamped = rows.withColumn("last_update", stamp)
        return stamped.select(*[F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in schema.split(", ")])

    def _write_stats(self, rows: DataFrame, name: str, schema: str, as_of) -> None:
        """The whole table: tenants without rows leave it."""
        versions.write(self._stamped_stats(rows, schema, as_of), self.path(name), ["user_id"], "overwrite")

    def refresh_rollup(self, as_of) -> None:
        """Recompute the buckets of the refresh window and leave all others.  The
        horizon moves in the same moment, if the window goes on from it."""
        start, end = rollup.refresh_window(as_of)
        known = self.rollup_horizon()
        notes = {"horizon": str(end)} if known is not None and start <= known < end else None
        fresh = layout.with_date(rollup.refreshed_buckets(self.observations(start, end), as_of), "bucket")
        published = self._read("rollup_1h", _ROLLUP, layout.days_between(start, end))
        days = F.col("date").between(F.lit(start.date().isoformat()).cast("date"), F.lit(end.date().isoformat()).cast("date"))
        kept = published.where(days & ~in_range(published, "bucket", start, end, end_inclusive=False))
        layout.replace_partitions(kept.unionByName(fresh.select(kept.columns)), self.path("rollup_1h"), ["date"], notes=notes)

    def rollup_horizon(self) -> datetime | None:
        """The time up to which every hour is in the rollup, None before a full one."""
        noted = versions.current(self.spark, self.path("rollup_1h")).notes.get("horizon")
        return as_datetime(noted) if noted else None

    def refresh_full_rollup(self) -> None:
        """Every bucket from scratch.  The hour of the newest observation is left
        for a later refresh to call complete."""
        path = self.path("rollup_1h")
        rolled = layout.with_date(rollup.hourly_rollup(self.observations()), "bucket").select(_names(_ROLLUP))
        part = versions.prepare(rolled.hint("rebalance", "date").sortWithinPartitions("user_id", "cml_id", "bucket"), path, ["date"])
        written = self.spark.read.schema(_ROLLUP).parquet(f"{path}/parts/{part}")
        newest = written.select(F.date_format(F.max("bucket"), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
        versions.publish(self.spark, path, part, 1, "overwrite", {"horizon": newest or ""})

    def append_log(self, rows: DataFrame) -> None:
        """One row per file and modification time, however often a batch is run."""
        dated = rows.withColumn("date", F.to_date("file_modified"))
        dated = dated.withColumn("id", F.abs(F.xxhash64("file_path", "file_modified")))
        known = layout.of_days(self.file_log(), dated).select("file_path", "file_modified")
        fresh = dated.join(known, ["file_path", "file_modified"], "left_anti")
        names = ["id", *[f.name for f in FILE_LOG.fields], "date"]
        versions.write(fresh.select(*names), self.path("file_log"), ["date"])

    def series(self, start, end) -> DataFrame:
        """Hourly values of a long range from the rollup, with the hours that it
        does not have yet computed from raw rows; raw rows for a short range.  Hours
        are whole ones, that of ``end`` too."""
        if rollup.resolve_source(start, end) == "raw":
            return self.observations(start, end)
        horizon = max(as_datetime(start), self.rollup_horizon() or as_datetime(start))
        last = as_datetime(end).replace(minute=0, second=0, microsecond=0) + timedelta(hours=1, microseconds=-1)
        rolled = self._read("rollup_1h", _ROLLUP, layout.days_between(start, end))
        published = layout.within(rolled, start, end, "bucket").drop("date")
        return rollup.rollup_with_tail(published, self.observations(horizon, last), horizon, start, end)

    def expire(self, keep: int = versions.KEPT_VERSIONS, hours: float = 24) -> None:
        """Remove what only older versions of the tables need."""
        for name in ("observations", "links", "daily_stats", "panes", "lifetime_stats", "windowed_stats", "rollup_1h", "file_log"):
            versions.expire(self.spark, self.path(name), keep, hours)

    def key_problems(self) -> dict[str, DataFrame]:
        """Repeated keys per table; all frames are empty when the keys hold."""
        return {
            "observations": upsert.repeated_keys(self.observations(), OBSERVATION_KEY),
            "links": upsert.repeated_keys(self.links(), LINK_KEY),
            "link_stats": upsert.repeated_keys(self.link_stats(), STATS_KEY),
            "rollup_1h": upsert.repeated_keys(self.rollup(), ROLLUP_KEYS),
        }
