"""Row selections. Every bound is a literal, so it is pushed to the scan."""

from pyspark.sql import functions as F

from ..functions.clock import to_millis

ALL_REGIONS = "ALL"

# The five-year window and its least magnitude; the split of its strata;
# alert levels that need dispatch.
WINDOW_START = "2020-01-01"
WINDOW_END = "2024-12-31 23:59:59"
MAJOR = 5.0
STRATUM_SPLIT = 6.2
DISPATCH_LEVELS = ("yellow", "orange", "red")


def slice_quakes(quakes, min_magnitude=2.5, depth=(0, 700), region=ALL_REGIONS):
    """The interactive slice: least magnitude, depth range, one region or all."""
    kept = quakes.filter(
        (F.col("magnitude") >= F.lit(float(min_magnitude)))
        & F.col("depth_km").between(float(depth[0]), float(depth[1]))
    )
    return kept if region == ALL_REGIONS else kept.filter(F.col("region") == region)


def _or_all(rows, condition):
    """Rows meeting ``condition``, or all rows if none does.

    The test is a one-row scalar subquery inside the same plan: no action on the driver. It
    has the condition pushed to its scan, and each of its tasks stops at the first hit.
    """
    any_met = rows.filter(condition).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    return rows.filter(F.coalesce(condition, F.lit(False)) | ~any_met)


def major_in_window(quakes, start=WINDOW_START, end=WINDOW_END, min_magnitude=MAJOR):
    """Major events of the window; major events of any time if the window has none."""
    major = quakes.filter(F.col("magnitude") >= F.lit(float(min_magnitude)))
    inside = F.col("epoch_millis").between(to_millis(start), to_millis(end))
    return _or_all(major, inside)


def major_or_all(quakes, min_magnitude=MAJOR):
    return _or_all(quakes, F.col("magnitude") >= F.lit(float(min_magnitude)))


def dispatch(quakes):
    """Events that need immediate notice: a tsunami warning or a raised alert level."""
    return quakes.filter(
        (F.col("tsunami_flag") == 1) | F.col("alert_level").isin(*DISPATCH_LEVELS)
    )


def felt(quakes):
    return quakes.filter(F.col("felt_reports") > 0)


def alerted(quakes):
    return quakes.filter(F.col("alert_level") != "none")


def known_region(rows):
    return rows.filter(F.col("region") != "GLOBAL_OTHER")


def with_stratum(quakes, split=STRATUM_SPLIT):
    return quakes.withColumn(
        "stratum", F.when(F.col("magnitude") >= split, "major").otherwise("moderate")
    )
