"""Operators on small frames, against values worked out by hand."""

import math
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fadeline.operators import increments, links, pipeline_log, quality, raw, rollup, series, stats, tenancy, upsert, validate

T0 = datetime(2026, 1, 1)
OBS = "time timestamp_ntz, cml_id string, sublink_id string, rsl double, tsl double, user_id string"


def obs(spark, *items):
    """Items are (minutes after T0, link, sublink, rsl)."""
    data = [(T0 + timedelta(minutes=m), c, s, r, 1.0, "t") for m, c, s, r in items]
    return spark.createDataFrame(data, OBS)


def meta(spark, *pairs, user="t"):
    data = [(c, s, 1.0, 2.0, 3.0, 4.0, 18.0, "H", 5.0, user) for c, s in pairs]
    return spark.createDataFrame(
        data, "cml_id string, sublink_id string, site_0_lon double, site_0_lat double, site_1_lon double, site_1_lat double, frequency double, polarization string, length double, user_id string"
    )


def test_windowed_stats_bounds_and_silent_links(spark):
    data = obs(spark, (0, "1", "a", -40.0), (300, "1", "a", -42.0), (300, "1", "b", None), (361, "1", "a", -44.0), (0, "2", "a", -9.0))
    known = meta(spark, ("1", "a"), ("2", "a"), ("3", "a"))
    got = {r["cml_id"]: r for r in stats.windowed_stats(data, known, T0 + timedelta(minutes=360)).collect()}
    one = got["1"]
    assert (one["total_records_6h"], one["valid_records_6h"], one["completeness_percent_6h"]) == (4, 3, 75.0)
    assert (one["mean_rsl_6h"], one["stddev_rsl_6h"], one["mean_rsl_1h"], one["last_rsl"]) == (-42.0, 2.0, -43.0, -44.0)
    assert (got["3"]["total_records_6h"], got["3"]["completeness_percent_6h"], got["3"]["mean_rsl_6h"], got["3"]["last_rsl"]) == (0, None, None, None)
    late = {r["cml_id"]: r for r in stats.windowed_stats(data, known, T0 + timedelta(days=2)).collect()}
    assert (late["1"]["total_records_6h"], late["1"]["last_rsl"], late["2"]["last_rsl"]) == (0, -44.0, -9.0)
    stored = stats.last_values(data)
    again = stats.windowed_stats(data, known, T0 + timedelta(minutes=360), stored)
    assert rows(again) == rows(stats.windowed_stats(data, known, T0 + timedelta(minutes=360)))


def test_last_value_may_be_null_and_ties_go_to_the_higher_sublink(spark):
    data = obs(spark, (0, "1", "a", -1.0), (5, "1", "a", -2.0), (5, "1", "b", None), (5, "2", "b", -3.0), (5, "2", "a", None))
    assert rows(stats.last_values(data), "cml_id", "last_rsl") == [("1", None), ("2", -3.0)]


def test_upsert_stats_keeps_the_other_columns(spark):
    data = obs(spark, (0, "1", "a", -1.0), (0, "2", "a", -2.0))
    stored = stats.empty_stats(stats.lifetime_stats(data), T0)
    window = stats.windowed_stats(data, meta(spark, ("2", "a"), ("3", "a")), T0)
    got = {r["cml_id"]: r for r in stats.upsert_stats(stored, window, T0 + timedelta(hours=1)).collect()}
    assert (got["1"]["total_records"], got["1"]["total_records_6h"], got["1"]["last_update"]) == (1, None, T0)
    assert (got["2"]["total_records"], got["2"]["total_records_6h"], got["2"]["last_update"]) == (1, 1, T0 + timedelta(hours=1))
    assert (got["3"]["total_records"], got["3"]["total_records_6h"]) == (None, 0)
    back = stats.upsert_stats(stats.upsert_stats(stored, window, T0), stats.lifetime_stats(data), T0)
    assert {r["cml_id"]: r["total_records_6h"] for r in back.collect()} == {"1": None, "2": 1, "3": 0}


def test_completeness_of_nothing_is_null(spark):
    data = obs(spark, (0, "1", "a", None))
    assert rows(quality.overall_completeness(data, "2027-01-01", "2027-01-02")) == [(None, None)]
    assert rows(quality.overall_completeness(data)) == [(0.0, "red")]
    assert rows(quality.quality_counts(data)) == [(0, 1, 1)]


def test_rollup_of_empty_frame(spark):
    empty = obs(spark).limit(0)
    assert rows(rollup.time_range(rollup.hourly_rollup(empty))) == [(None, None)]
    assert rows(links.total_records(stats.lifetime_stats(empty))) == [(0,)]
    assert rows(links.network_extent(meta(spark).limit(0)), "links", "min_lon") == [(0, None)]


def test_missing_references(spark):
    data = obs(spark, (0, "123", "sublink_1", 1.0), (0, "123", "sublink_2", 1.0), (0, "456", "sublink_1", 1.0), (0, "789", "sublink_1", 1.0))
    known = meta(spark, ("123", "sublink_1"))
    expected = [("123", "sublink_2"), ("456", "sublink_1"), ("789", "sublink_1")]
    assert [tuple(r) for r in validate.missing_references(data, known).select("cml_id", "sublink_id").collect()] == expected
    assert {r["missing_pairs"] for r in validate.missing_reference_warning(data, known, 2).collect()} == {3}
    other = meta(spark, ("123", "sublink_2"), user="someone")
    assert validate.missing_references(data, known.unionByName(other)).count() == 3
    assert rows(validate.orphan_count(data, known.unionByName(other))) == rows(validate.orphan_count_left_join(data, known.unionByName(other))) == [(2,)]


def test_missing_references_broadcast_no_links(spark):
    data = obs(spark, (0, "123", "sublink_1", 1.0), (1, "123", "sublink_1", 1.0), (0, None, "sublink_1", 1.0), (0, "9", "sublink_1", 1.0))
    known = meta(spark, ("123", "sublink_1"), ("123", "sublink_1"), (None, "sublink_1"))
    missing = validate.missing_references(data, known)
    assert [tuple(r) for r in missing.select("cml_id", "sublink_id").collect()] == [(None, "sublink_1"), ("9", "sublink_1")]
    assert "Join" not in missing._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "lon, valid", [([13.4, 13.5], True), ([180.0, -180.0], True), ([180.1, 0.0], False), ([13.4, None], False), ([None, None], True)]
)
def test_coordinate_rule(spark, lon, valid):
    frame = meta(spark, ("1", "a"), ("1", "b"))
    values = F.when(F.col("sublink_id") == "a", F.lit(lon[0])).otherwise(F.lit(lon[1])).cast("double")
    checked = frame.withColumn("site_1_lon", values)
    assert rows(validate.validate_frame(checked, "metadata")) == [(valid,)]
    named = checked.withColumn("filename", F.lit("f"))
    assert rows(validate.coordinate_check(named), "valid") == [(valid,)]


def test_validate_frame(spark):
    data = obs(spark, (0, "1", "a", None))
    assert rows(validate.validate_frame(data, "rawdata")) == [(True,)]
    assert rows(validate.validate_frame(data.limit(0), "rawdata")) == [(False,)]
    assert rows(validate.validate_frame(data.drop("tsl"), "rawdata")) == [(False,)]
    assert rows(validate.validate_frame(data, "something")) == [(False,)]
    null_time = data.unionByName(data.withColumn("time", F.lit(None).cast("timestamp_ntz")))
    assert rows(validate.validate_frame(null_time, "rawdata")) == [(False,)]
    with pytest.raises(ValueError):
        validate.missing_columns(data, "something")


def test_fill_nulls_needs_both_files(spark):
    base = obs(spark, (0, "1", "a", -1.0)).withColumns({"tsl": F.lit(None).cast("double"), "seq": F.lit(1)})
    other = obs(spark, (0, "1", "a", None)).withColumns({"tsl": F.lit(7.0), "seq": F.lit(2)})
    later = obs(spark, (0, "1", "a", -9.0)).withColumns({"tsl": F.lit(9.0), "seq": F.lit(3)})
    every = base.unionByName(other).unionByName(later)
    assert rows(upsert.fill_nulls(every), "rsl", "tsl", "seq") == [(-1.0, 7.0, 1)]
    assert rows(upsert.first_wins(every), "rsl", "tsl") == [(-1.0, None)]
    assert rows(upsert.last_wins(every, ["time", "cml_id"]), "rsl", "tsl") == [(-9.0, 9.0)]


def test_has_repeated_keys(spark):
    data = obs(spark, (0, "1", "a", 1.0), (1, "1", "a", 1.0))
    assert not upsert.has_repeated_keys(data)
    assert upsert.has_repeated_keys(data.unionByName(data.limit(1)))


def test_hot_key_of_copies(spark):
    """A third of the rows are copies of one key."""
    copies = spark.range(1000).select(
        F.lit(T0).cast("timestamp_ntz").alias("time"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("cml_id"),
        F.lit("a").alias("sublink_id"), F.col("id").cast("double").alias("rsl"), F.lit("t").alias("user_id"), F.col("id").alias("seq"),
    )
    kept = upsert.first_wins(copies)
    assert kept.count() == 667
    assert rows(kept.where("cml_id = 'hot'"), "rsl", "seq") == [(0.0, 0)]


def test_active_sublinks(spark):
    data = obs(spark, (0, "1", "a", None), (1, "2", "a", -1.0), (0, "1", "b", None), (0, "1", "c", -1.0))
    assert rows(raw.keep_active_sublinks(data, data).select("sublink_id").distinct()) == [("a",), ("c",)]
    assert rows(raw.sublinks_with_data(data)) == [("a",), ("c",)]


def test_newest_rows_over_hours_with_few_rows(spark):
    data = obs(spark, *[(i * 45, str(i), "a", float(i)) for i in range(40)])
    assert [r["cml_id"] for r in raw.newest_rows(data, limit=7).collect()] == [str(i) for i in range(39, 32, -1)]
    assert raw.newest_rows(data, limit=100).count() == 40
    assert raw.newest_rows(data, search="zzz").count() == 0


def test_shift_and_cut(spark):
    data = obs(spark, (0, "1", "a", 1.0), (1440, "1", "a", 2.0), (2880, "1", "a", 3.0))
    shifted = series.shift_to_end(data, "2026-06-01 00:00:00")
    assert rows(shifted, "time") == [(datetime(2026, 5, 30),), (datetime(2026, 5, 31),), (datetime(2026, 6, 1),)]
    assert rows(series.last_days(data, 1), "rsl") == [(3.0,)]
    assert rows(series.last_days(data, 0), "rsl") == [(1.0,), (2.0,), (3.0,)]
    assert rows(series.last_steps(data, 2), "rsl") == [(2.0,), (3.0,)]


def test_replay_against_brute_force(spark):
    step, interval, loop = 60, 25, 700
    source = obs(spark, *[(i, "1", "a", float(i)) for i in range(10)])
    start, end = datetime(2026, 3, 1), datetime(2026, 3, 1, 1)
    got = series.replay(source, start, end, timedelta(seconds=interval), timedelta(seconds=loop), timedelta(seconds=step))
    span = 9 * step
    expected = []
    for i in range(int(3600 / interval) + 1):
        position = (i * interval % loop) % span
        expected.append((start + timedelta(seconds=i * interval), float(math.floor(position / step))))
    assert rows(got, "time", "rsl") == sorted(expected, key=repr)
    single = source.where("rsl = 0")
    assert series.replay(single, start, end, timedelta(hours=1), timedelta(hours=1), timedelta(seconds=step)).count() == 2
    assert series.replay(source, end, start, timedelta(hours=1), timedelta(hours=1), timedelta(seconds=step)).count() == 0


def test_backfill_windows(spark):
    kind = "source string, cursor timestamp_ntz, backfill_start timestamp_ntz, backfill_end timestamp_ntz"
    day = timedelta(days=1)
    sources = spark.createDataFrame(
        [("fresh", None, T0, T0 + day * 1.5), ("half", T0 + day, T0, T0 + day * 1.5), ("done", T0 + day * 1.5, T0, T0 + day * 1.5)], kind
    )
    assert rows(increments.backfill_windows(sources, 24)) == [("fresh", T0, T0 + day), ("fresh", T0 + day, T0 + day * 1.5), ("half", T0 + day, T0 + day * 1.5)]


def test_continuous_window(spark):
    hour = timedelta(hours=1)
    now = T0 + 24 * hour
    data = [("first", None), ("behind", T0), ("near", now - hour), ("ahead", now + 10 * hour)]
    sources = spark.createDataFrame(data, "source string, cursor timestamp_ntz")
    got = increments.continuous_window(sources, now, chunk_hours=6, overlap_seconds=300)
    early = timedelta(seconds=300)
    assert rows(got) == [("behind", T0 - early, T0 + 6 * hour), ("first", now - 6 * hour, now), ("near", now - hour - early, now)]


def test_open_windows(spark):
    planned = spark.createDataFrame([("s", T0)], "source string, window_start timestamp_ntz")
    planned = increments.with_variants(planned, ["a", "b", "c", "d"])
    ledger = spark.createDataFrame([("s", T0, "a", "done"), ("s", T0, "b", "failed"), ("s", T0, "c", "empty")], "source string, window_start timestamp_ntz, variant string, status string")
    assert rows(increments.open_windows(planned, ledger), "variant") == [("b",), ("d",)]


def test_unseen_files_look_at_the_last_version(spark):
    kind = "source string, filename string, mtime int"
    inventory = spark.createDataFrame([("s", "same", 1), ("s", "changed", 2), ("s", "new", 1), ("s", "restored", 1), ("other", "same", 1)], kind)
    ledger = spark.createDataFrame([("s", "same", 1, 1), ("s", "changed", 1, 1), ("s", "restored", 1, 1), ("s", "restored", 2, 2)], kind + ", seen_at int")
    assert rows(increments.unseen_files(inventory, ledger)) == [("other", "same", 1), ("s", "changed", 2), ("s", "new", 1), ("s", "restored", 1)]


LOG = "id bigint, user_id string, filename string, status string, rows_written int, error_message string, processed_at timestamp_ntz"


def log(spark):
    data = [
        (1, "t", "cml_data_20260505.csv", "archived", 756, None, datetime(2026, 5, 5, 9)),
        (2, "t", "bad_file.csv", "quarantined", None, "Parse error", datetime(2026, 5, 5, 8)),
        (3, "u", "more.csv", "archived", None, None, datetime(2026, 5, 1, 8)),
    ]
    return spark.createDataFrame(data, LOG)


def test_log_reports(spark):
    files = log(spark)
    assert rows(pipeline_log.log_totals(files)) == [(2, 1, 756, 66.7)]
    assert rows(pipeline_log.log_totals(files.limit(0))) == [(0, 0, 0, None)]
    assert rows(pipeline_log.log_last_day(files, "2026-05-06 08:30:00")) == [(0, 1, 756, "green")]
    assert rows(pipeline_log.log_by_user(files, "2026-05-06"), "user_id", "success_rate_pct", "quarantine_band") == [("t", 50.0, "yellow"), ("u", 100.0, "green")]
    assert rows(pipeline_log.log_page(files, status="nonsense", search=" BAD "), "id") == [(2,)]
    assert [r["id"] for r in pipeline_log.log_page(files, per_page=2).collect()] == [1, 2]
    assert [r["id"] for r in pipeline_log.log_page(files, page=2, per_page=2).collect()] == [3]
    assert [r["id"] for r in pipeline_log.log_page_after(files, "2026-05-05 08:00:00", 2, per_page=2).collect()] == [3]
    assert rows(pipeline_log.log_page_info(files.limit(0))) == [(0, 1, 1, 1)]
    assert rows(pipeline_log.log_page_info(files, page=9, per_page=1)) == [(3, 3, 7, 3)]


def test_write_check(spark):
    scope = tenancy.TenantScope("t", frozenset({"t", "u"}))
    checked = scope.check_write(spark.createDataFrame([("t",), ("u",), (None,)], "user_id string"))
    assert rows(checked) == sorted([("t", True, None), ("u", False, "row belongs to u"), (None, False, "row belongs to nobody")], key=repr)
    assert rows(scope.stamp(spark.createDataFrame([("u",)], "user_id string"))) == [("t",)]
    assert rows(scope.table(log(spark)), "id") == [(1,), (2,)]
    assert tenancy.AdminScope().table(log(spark)).count() == 3


def test_one_link_is_centred_on_its_midpoint(spark):
    extent = links.network_extent(meta(spark, ("1", "a"), ("1", "b")))
    assert rows(extent, "links", "midpoint_lon", "midpoint_lat") == [(1, 2.0, 3.0)]
    assert rows(links.network_extent(meta(spark, ("1", "a"), ("2", "a"))), "midpoint_lon") == [(None,)]
    assert rows(links.with_length(meta(spark, ("1", "a"))), "length") == [(5.0,)]


def test_absent_rows_are_inserted_once(spark):
    kind = "cml_id string, sublink_id string, user_id string, length double"
    stored = spark.createDataFrame([("a", "s", "t", 1.0)], kind)
    incoming = spark.createDataFrame([("b", "s", "t", 3.0), ("b", "s", "t", 2.0), ("a", "s", "t", 9.0)], kind)
    assert rows(upsert.insert_if_absent(stored, incoming)) == [("a", "s", "t", 1.0), ("b", "s", "t", 2.0)]
    ordered = incoming.withColumn("seq", F.when(F.col("length") == 3, 1).otherwise(2).cast("bigint"))
    assert rows(upsert.insert_if_absent(stored, ordered)) == [("a", "s", "t", 1.0), ("b", "s", "t", 3.0)]
