"""All rollups from one scan.

Counts, sums and maxima add up, so the table is reduced once to one row per hour, region,
depth class, alert level, tsunami flag and magnitude step. That cube is bounded by the calendar
and the classes, not by the number of events; every rollup is a small aggregate of it.
"""

from pyspark.sql import functions as F

from ..functions.clock import bucket, calendar
from ..functions.measures import depth_class
from ..operators.statistics import cumulative_counts, magnitude_step

KEYS = ("hour", "region", "depth_category", "alert_level", "tsunami_flag", "step")


def build(quakes):
    return quakes.groupBy(
        bucket("event_time", "hour").alias("hour"),
        "region",
        depth_class("depth_km").alias("depth_category"),
        "alert_level",
        "tsunami_flag",
        magnitude_step().alias("step"),
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("magnitude").alias("magnitudes"),
        F.max("magnitude").alias("max_magnitude"),
        F.sum("depth_km").alias("depths"),
        F.sum("felt_reports").alias("felt"),
        F.sum("seismic_energy_joules").alias("energy"),
    )


def _count(name):
    return F.sum("events").alias(name)


def _mean(total="magnitudes", name="avg_magnitude"):
    return (F.sum(total) / F.sum("events")).alias(name)


def _max():
    return F.max("max_magnitude").alias("max_magnitude")


def _energy(name="total_energy_joules"):
    return F.sum("energy").alias(name)


def activity(cube, unit):
    window = f"{unit}_window"
    return cube.groupBy(bucket("hour", unit).alias(window)).agg(
        _count("total_events"), _mean(), _max(), _energy()
    )


def regional_scorecard(cube):
    return cube.groupBy("region").agg(
        _count("event_count"), _mean(), _max(), _mean("depths", "avg_depth_km"),
        F.sum(F.col("tsunami_flag") * F.col("events")).alias("tsunami_warnings"),
        F.sum("felt").alias("total_felt_reports"), _energy("cumulative_energy_joules"),
    )


def depth_strata(cube):
    return cube.groupBy("depth_category").agg(_count("event_count"), _mean(), _max())


def diurnal(cube):
    return cube.groupBy(*calendar("hour")).agg(_count("event_count"), _mean(), _energy())


def pager(cube):
    return cube.groupBy("alert_level", "tsunami_flag").agg(
        _count("event_count"), _mean(), _max(), F.sum("felt").alias("total_felt")
    )


def frequency_magnitude(cube):
    counts = cube.filter(F.col("step").isNotNull()).groupBy("step").agg(F.sum("events").alias("n"))
    return cumulative_counts(counts)


# Rollup name -> builder and the columns its file is ordered by.
ROLLUPS = {
    "hourly_activity": (lambda c: activity(c, "hour"), ["hour_window"]),
    "daily_activity": (lambda c: activity(c, "day"), ["day_window"]),
    "monthly_activity": (lambda c: activity(c, "month"), ["month_window"]),
    "regional_summary": (regional_scorecard, ["-event_count", "region"]),
    "depth_summary": (depth_strata, ["depth_category"]),
    "diurnal_hourly_weekly": (diurnal, ["day_idx", "hour_of_day"]),
    "frequency_magnitude": (frequency_magnitude, ["magnitude"]),
    "pager_tsunami_summary": (pager, ["alert_level", "tsunami_flag"]),
}
