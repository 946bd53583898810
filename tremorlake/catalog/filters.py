"""Row selections."""

from pyspark.sql import functions as F

from ..operators import filters
from ..sources.events_view import quakes
from .registry import oracle, query

ROW = ("event_id", "magnitude", "depth_km", "region", "epoch_millis")
_ROW_SQL = "SELECT event_id, magnitude, depth_km, region, epoch_millis FROM quakes WHERE "


@query("d1_slice_region", oracle(
    _ROW_SQL + "mag10 >= 25 AND depth_km BETWEEN 35 AND 300 AND region = 'CALIFORNIA'"))
def slice_region(spark, sf_dir):
    return filters.slice_quakes(quakes(spark, sf_dir), 2.5, (35, 300), "CALIFORNIA").select(*ROW)


@query("d1_slice_all", oracle(_ROW_SQL + "mag10 >= 25 AND depth_km BETWEEN 0 AND 700"))
def slice_all(spark, sf_dir):
    return filters.slice_quakes(quakes(spark, sf_dir)).select(*ROW)


@query("d2_major_in_window", oracle(
    _ROW_SQL + "mag10 >= 50 AND event_time BETWEEN TIMESTAMP '2020-01-01' "
    "AND TIMESTAMP '2024-12-31 23:59:59'"))
def major_in_window(spark, sf_dir):
    return filters.major_in_window(quakes(spark, sf_dir)).select(*ROW)


@query("d2_major_in_window_fallback", oracle(_ROW_SQL + "mag10 >= 50"))
def major_fallback(spark, sf_dir):
    """No event falls in the window, so all major events are given."""
    return filters.major_in_window(quakes(spark, sf_dir), "2030-01-01", "2030-12-31").select(*ROW)


@query("d3_major_or_all", oracle(_ROW_SQL + "mag10 >= 50"))
def major_or_all(spark, sf_dir):
    return filters.major_or_all(quakes(spark, sf_dir)).select(*ROW)


@query("d3_major_or_all_fallback", oracle(_ROW_SQL + "true"))
def all_rows(spark, sf_dir):
    return filters.major_or_all(quakes(spark, sf_dir), 11.0).select(*ROW)


@query("d4_dispatch", oracle(
    "SELECT event_id, alert_level, tsunami_flag FROM quakes "
    "WHERE tsunami_flag = 1 OR alert_level IN ('yellow', 'orange', 'red')"))
def dispatch(spark, sf_dir):
    return filters.dispatch(quakes(spark, sf_dir)).select("event_id", "alert_level", "tsunami_flag")


@query("d5_felt", oracle(
    "SELECT event_id, magnitude, felt_reports FROM quakes WHERE felt_reports > 0"))
def felt(spark, sf_dir):
    return filters.felt(quakes(spark, sf_dir)).select("event_id", "magnitude", "felt_reports")


@query("d5_alerted", oracle(
    "SELECT event_id, alert_level FROM quakes WHERE alert_level <> 'none'"))
def alerted(spark, sf_dir):
    return filters.alerted(quakes(spark, sf_dir)).select("event_id", "alert_level")


@query("d5_known_region", oracle(
    "SELECT event_id, region FROM quakes WHERE region <> 'GLOBAL_OTHER'"))
def known_region(spark, sf_dir):
    return filters.known_region(quakes(spark, sf_dir)).select("event_id", "region")


@query("d6_strata", oracle("""
SELECT CASE WHEN mag10 >= 62 THEN 'major' ELSE 'moderate' END AS stratum, count(*) AS events,
       min(magnitude) AS least, max(magnitude) AS largest
FROM quakes WHERE mag10 >= 50 GROUP BY 1"""))
def strata(spark, sf_dir):
    rows = filters.with_stratum(filters.major_in_window(quakes(spark, sf_dir)))
    return rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("events"), F.min("magnitude").alias("least"),
        F.max("magnitude").alias("largest"),
    )
