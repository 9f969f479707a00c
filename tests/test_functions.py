from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fadeline.functions import bands, geo, identity, numbers, text, times
from fadeline.operators import pipeline_log, rollup, tenancy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def utc(value):
    """Collected timestamps are local wall time of the driver; compare instants."""
    return value.astimezone(timezone.utc).replace(tzinfo=None)


@pytest.mark.parametrize(
    "text_in, zone, expected",
    [
        ("2026-01-22 11:00:00", "Africa/Douala", datetime(2026, 1, 22, 10)),
        ("2026-01-22 10:00:00+02:00", "Africa/Douala", datetime(2026, 1, 22, 8)),
        ("2026-01-22T10:00:00Z", "Africa/Douala", datetime(2026, 1, 22, 10)),
        ("2026-01-22 10:00:00", None, datetime(2026, 1, 22, 10)),
        ("2026-01-20 09:30:38.196389", None, datetime(2026, 1, 20, 9, 30, 38, 196389)),
        ("2026-07-01 12:00:00", "Europe/Berlin", datetime(2026, 7, 1, 10)),
        # spring gap: the first valid instant
        ("2026-03-29 02:30:00", "Europe/Berlin", datetime(2026, 3, 29, 1)),
        ("2026-03-29 02:00:00", "Europe/Berlin", datetime(2026, 3, 29, 1)),
        ("2026-03-29 03:00:00", "Europe/Berlin", datetime(2026, 3, 29, 1)),
        # a gap of half an hour
        ("2026-10-04 02:10:00", "Australia/Lord_Howe", datetime(2026, 10, 3, 15, 30)),
        # a whole day that a zone left out
        ("2011-12-30 13:30:00", "Pacific/Apia", datetime(2011, 12, 30, 10)),
        # autumn overlap: the earlier instant
        ("2026-10-25 02:30:00", "Europe/Berlin", datetime(2026, 10, 25, 0, 30)),
        ("not a time", "Europe/Berlin", None),
        ("", None, None),
    ],
)
def test_to_utc(spark, text_in, zone, expected):
    got = one(spark, times.to_utc(F.lit(text_in), zone).cast("timestamp_ntz"))
    assert got == expected


def test_to_utc_ambiguous_null(spark):
    berlin = "Europe/Berlin"
    assert one(spark, times.to_utc(F.lit("2026-10-25 02:30:00"), berlin, "null")) is None
    assert one(spark, times.to_utc(F.lit("2026-10-25 03:30:00"), berlin, "null")) is not None
    with pytest.raises(ValueError):
        times.to_utc(F.lit(""), berlin, "later")


@pytest.mark.parametrize(
    "value, decimal, expected",
    [("1.5", ".", 1.5), (" -39.8 ", ".", -39.8), ("1,5", ",", 1.5), ("abc", ".", None), ("", ".", None), ("NaN", ".", None), ("inf", ".", None)],
)
def test_to_number(spark, value, decimal, expected):
    assert one(spark, numbers.to_number(F.lit(value), decimal)) == expected


@pytest.mark.parametrize("value, digits, expected", [(1.005, 2, 1.01), (2.675, 2, 2.68), (-10.0149999999999994, 2, -10.02), (-2.5, 0, -3.0), (None, 2, None)])
def test_half_up(spark, value, digits, expected):
    assert one(spark, numbers.half_up(F.lit(value).cast("double"), digits)) == expected


def test_percent_of_nothing_is_null(spark):
    assert one(spark, numbers.percent(F.lit(0), F.lit(0))) is None


def test_ids(spark):
    assert one(spark, identity.id_text(F.lit(None).cast("string"))) == "nan"
    assert one(spark, identity.id_text(F.lit("0010"))) == "0010"
    assert one(spark, identity.stored_sublink(F.lit("nan"))) is None
    assert one(spark, identity.relabel(F.lit("a"), {"a": "b"})) == "b"
    assert one(spark, identity.relabel(F.lit("c"), {"a": "b"})) == "c"
    assert one(spark, identity.relabel(F.lit("c"), {})) == "c"
    assert one(spark, identity.tenant_or_default(F.lit(None).cast("string"))) == identity.DEFAULT_TENANT


def test_haversine_of_known_link(spark):
    length = one(spark, geo.haversine_m(*[F.lit(x) for x in (11.99507, 57.70368, 11.99110, 57.69785)]))
    assert length == pytest.approx(689.85, abs=0.01)


@pytest.mark.parametrize("percent, has, band", [(90.0, True, "green"), (89.99, True, "yellow"), (70.0, True, "yellow"), (50.0, True, "orange"), (49.9, True, "red"), (None, True, "red"), (99.0, False, "blue")])
def test_completeness_band(spark, percent, has, band):
    assert one(spark, bands.completeness_band(F.lit(percent).cast("double"), F.lit(has))) == band


@pytest.mark.parametrize("rsl, band", [(-40.0, "green"), (-45.0, "yellow"), (-50.0, "orange"), (-50.1, "red"), (None, "grey")])
def test_signal_band(spark, rsl, band):
    assert one(spark, bands.signal_band(F.lit(rsl).cast("double"), F.lit(True))) == band


@pytest.mark.parametrize("std, band", [(1.0, "green"), (2.0, "yellow"), (3.0, "orange"), (3.1, "red"), (None, "grey")])
def test_stability_band(spark, std, band):
    assert one(spark, bands.stability_band(F.lit(std).cast("double"), F.lit(True))) == band


@pytest.mark.parametrize("n, alarm, user", [(0, "green", "green"), (1, "red", "yellow"), (4, "red", "yellow"), (5, "red", "red")])
def test_quarantine_bands(spark, n, alarm, user):
    assert one(spark, bands.quarantine_alarm(F.lit(n))) == alarm
    assert one(spark, bands.user_quarantine_band(F.lit(n))) == user


def test_short_error(spark):
    assert one(spark, text.short_error(F.lit("x" * 80))) == "x" * 80
    assert one(spark, text.short_error(F.lit("x" * 81))) == "x" * 80 + "…"
    assert one(spark, text.short_error(F.lit(None).cast("string"))) is None


def test_search_wildcards(spark):
    assert one(spark, text.contains_ci(F.lit("CML_Data"), "ml_d")) is True
    assert one(spark, text.contains_ci(F.lit("abc"), "a%c")) is True
    assert one(spark, text.contains_ci(F.lit("abc"), "")) is True
    assert one(spark, text.contains_ci(F.lit("abc"), None)) is True


def test_landed_name(spark):
    edges = [F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-02")]
    plain = one(spark, text.landed_name(F.lit("op"), *edges, F.lit("rsl")))
    assert plain == "op_20260101T000000Z_20260102_rsl_data.json"
    assert one(spark, text.landed_name(F.lit("op"), *edges, F.lit(""))) == "op_20260101T000000Z_20260102_data.json"
    first = one(spark, text.landed_name(F.lit("op"), *edges, F.lit("rsl"), variant_first=True))
    assert first == "op_rsl_20260101T000000Z_20260102_data.json"


def test_summary_leaves_out_missing_parts(spark):
    row = spark.sql(
        "SELECT '10001' AS cml_id, true AS has_stats, 90.0D AS completeness_percent_6h, 12L AS total_records_6h, 10L AS valid_records_6h, "
        "-45.0D AS last_rsl, CAST(NULL AS DOUBLE) AS stddev_rsl_1h"
    )
    got = row.select(text.link_summary().alias("s")).first()["s"]
    assert got == "CML 10001\nCompleteness (6h): 90%\nValid records (6h): 10/12\nLast RSL: -45 dBm"
    assert row.withColumn("has_stats", F.lit(False)).select(text.link_summary().alias("s")).first()["s"] == "CML 10001"


def test_whole_days_counts_elapsed_days(spark):
    a, b = F.lit("2026-01-01 23:00:00").cast("timestamp_ntz"), F.lit("2026-01-03 22:00:00").cast("timestamp_ntz")
    assert one(spark, times.whole_days(a, b)) == 1


@pytest.mark.parametrize("page, expected", [("2", 2), (0, 1), (-3, 1), ("x", 1), (None, 1)])
def test_page_number(page, expected):
    assert pipeline_log.page_number(page) == expected


def test_resolve_source():
    assert rollup.resolve_source("2026-01-01", "2026-01-04") == "raw"
    assert rollup.resolve_source("2026-01-01", "2026-01-04 00:00:01") == "rollup"


def test_refresh_window():
    start, end = rollup.refresh_window("2026-01-10 12:30:00")
    assert (start, end) == (datetime(2026, 1, 8, 13), datetime(2026, 1, 10, 11))


def test_unknown_tenant():
    with pytest.raises(ValueError, match="Unknown user_id"):
        tenancy.TenantScope("x", frozenset({"a"}))


@pytest.mark.parametrize("text", ["2026-01-22 10:00:00 UTC", "2026-01-22 10:00:00 GMT", "2026-01-22 11:00:00 Africa/Douala", "2026-01-22 10:00:00Z", "2026-01-22 11:00:00"])
def test_zone_names_are_not_shifted_again(spark, text):
    got = spark.range(1).select(times.to_utc(F.lit(text), "Africa/Douala").alias("t")).select(F.date_format("t", "HH:mm").alias("t")).first()["t"]
    assert got == "10:00"
