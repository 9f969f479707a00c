"""Colour bands of link quality and pipeline health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds in falling quality, and the names of the bands.
COMPLETENESS_STEPS = [(90, "green"), (70, "yellow"), (50, "orange")]
SIGNAL_STEPS = [(-40, "green"), (-45, "yellow"), (-50, "orange")]
STABILITY_STEPS = [(1, "green"), (2, "yellow"), (3, "orange")]
WORST = "red"
UNKNOWN = "grey"
NO_STATISTICS = "blue"
PANEL_COMPLETENESS_STEPS = [(90, "green"), (50, "yellow")]
USER_QUARANTINE_STEPS = [(5, "red"), (1, "yellow")]


def _at_least(x: Column, steps, rest: str) -> Column:
    band = F.lit(rest)
    for limit, name in reversed(steps):
        band = F.when(x >= limit, name).otherwise(band)
    return band


def _at_most(x: Column, steps, rest: str) -> Column:
    band = F.lit(rest)
    for limit, name in reversed(steps):
        band = F.when(x <= limit, name).otherwise(band)
    return band


def completeness_band(percent: Column, has_stats: Column) -> Column:
    band = _at_least(F.coalesce(percent, F.lit(0.0)), COMPLETENESS_STEPS, WORST)
    return F.when(has_stats, band).otherwise(NO_STATISTICS)


def signal_band(last_rsl: Column, has_stats: Column) -> Column:
    band = F.when(last_rsl.isNull(), UNKNOWN).otherwise(_at_least(last_rsl, SIGNAL_STEPS, WORST))
    return F.when(has_stats, band).otherwise(NO_STATISTICS)


def stability_band(stddev_1h: Column, has_stats: Column) -> Column:
    band = F.when(stddev_1h.isNull(), UNKNOWN).otherwise(_at_most(stddev_1h, STABILITY_STEPS, WORST))
    return F.when(has_stats, band).otherwise(NO_STATISTICS)


def panel_completeness_band(percent: Column) -> Column:
    return F.when(percent.isNotNull(), _at_least(percent, PANEL_COMPLETENESS_STEPS, "red"))


def quarantine_alarm(files: Column) -> Column:
    """Any quarantined file in the last day is an alarm."""
    return F.when(files >= 1, "red").otherwise("green")


def user_quarantine_band(files: Column) -> Column:
    return _at_least(files, USER_QUARANTINE_STEPS, "green")
