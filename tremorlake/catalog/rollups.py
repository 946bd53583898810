"""Grouped summaries."""

from pyspark.sql import functions as F

from ..operators import filters, rollups
from ..plans import warehouse
from ..sources.events_view import quakes
from .registry import as_text, oracle, query, rounded, terajoules

_MEAN = "round(avg(magnitude), 9) AS avg_magnitude"
_MAX = "max(magnitude) AS max_magnitude"
_TJ = "round(sum(energy) / 1e12, 3) AS total_energy_tj"


def _half_up(value, digits):
    """Round as decimal digits read, the way Spark rounds a double: 2.575 gives 2.58."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def _window_sql(unit, fmt="%Y-%m-%d %H:%M:%S"):
    return f"strftime(CAST(date_trunc('{unit}', event_time) AS TIMESTAMP), '{fmt}')"


def _activity(name, unit):
    sql = oracle(f"SELECT {_window_sql(unit)} AS {unit}_window, count(*) AS total_events, "
                 f"{_MEAN}, {_MAX}, {_TJ} FROM quakes GROUP BY 1")

    @query(name, sql)
    def run(spark, sf_dir):
        rows = rollups.activity(quakes(spark, sf_dir), unit)
        rows = terajoules(rows, "total_energy_joules", "total_energy_tj")
        return as_text(rounded(rows, avg_magnitude=9), f"{unit}_window")


_activity("e1a_hourly_activity", "hour")
_activity("e2_daily_activity", "day")
_activity("e3_monthly_activity", "month")


@query("e1b_hourly_activity_warehouse", oracle(f"""
SELECT {_window_sql('hour')} AS hour_window, count(*) AS total_events,
       {_half_up("avg(magnitude)", 2)} AS avg_magnitude, {_MAX}, {_TJ}
FROM quakes GROUP BY 1"""))
def hourly_warehouse(spark, sf_dir):
    warehouse.register(quakes(spark, sf_dir))
    return terajoules(spark.sql(warehouse.HOURLY), "total_energy_joules", "total_energy_tj")


@query("e4_weekly_activity", oracle(f"""
SELECT {_window_sql('week')} AS week_window, count(*) AS total_events, {_TJ}
FROM quakes WHERE mag10 >= 50 GROUP BY 1"""))
def weekly(spark, sf_dir):
    rows = rollups.weekly_energy(filters.major_in_window(quakes(spark, sf_dir)))
    return as_text(terajoules(rows, "total_energy_joules", "total_energy_tj"), "week_window")


@query("e5a_regional_scorecard", oracle(f"""
SELECT region, count(*) AS event_count, {_MEAN}, {_MAX}, round(avg(depth_km), 9) AS avg_depth_km,
       CAST(sum(tsunami_flag) AS BIGINT) AS tsunami_warnings,
       CAST(sum(felt_reports) AS BIGINT) AS total_felt_reports,
       round(sum(energy) / 1e12, 3) AS cumulative_energy_tj
FROM quakes GROUP BY region"""))
def scorecard(spark, sf_dir):
    rows = rollups.regional_scorecard(quakes(spark, sf_dir))
    rows = terajoules(rows, "cumulative_energy_joules", "cumulative_energy_tj")
    return rounded(rows, avg_magnitude=9, avg_depth_km=9)


@query("e5b_regional_scorecard_warehouse", oracle(f"""
SELECT region, count(*) AS event_count, {_half_up("avg(magnitude)", 2)} AS avg_magnitude,
       max(magnitude) AS max_magnitude, {_half_up("avg(depth_km)", 1)} AS avg_depth_km,
       CAST(sum(tsunami_flag) AS BIGINT) AS tsunami_warning_count,
       CAST(sum(felt_reports) AS BIGINT) AS total_felt_reports,
       round(sum(energy) / 1e12, 3) AS cumulative_energy_tj
FROM quakes GROUP BY region"""))
def scorecard_warehouse(spark, sf_dir):
    warehouse.register(quakes(spark, sf_dir))
    return terajoules(
        spark.sql(warehouse.SCORECARD), "cumulative_energy_joules", "cumulative_energy_tj"
    )


@query("e6a_depth_strata", oracle(f"""
SELECT CASE WHEN depth_km < 35 THEN 'Shallow (0-35 km)' WHEN depth_km <= 150
            THEN 'Intermediate (35-150 km)' ELSE 'Deep (150-700 km)' END AS depth_category,
       count(*) AS event_count, {_MEAN}, {_MAX}
FROM quakes GROUP BY 1"""))
def depth(spark, sf_dir):
    return rounded(rollups.depth_strata(quakes(spark, sf_dir)), avg_magnitude=9)


@query("e6b_depth_strata_warehouse", oracle(f"""
SELECT CASE WHEN depth_km < 35 THEN 'Shallow (0-35 km) - High Crustal Risk' WHEN depth_km <= 150
            THEN 'Intermediate (35-150 km) - Subduction Zone'
            ELSE 'Deep (150-700 km) - Mantle Transition' END AS depth_classification,
       count(*) AS event_count, {_half_up("avg(magnitude)", 2)} AS avg_magnitude,
       max(magnitude) AS max_magnitude
FROM quakes GROUP BY 1"""))
def depth_warehouse(spark, sf_dir):
    warehouse.register(quakes(spark, sf_dir))
    return spark.sql(warehouse.DEPTH)


@query("e7_diurnal", oracle(f"""
SELECT CAST(isodow(event_time) - 1 AS INTEGER) AS day_idx, dayname(event_time) AS day_of_week,
       CAST(hour(event_time) AS INTEGER) AS hour_of_day, count(*) AS event_count, {_MEAN}, {_TJ}
FROM quakes GROUP BY 1, 2, 3"""))
def diurnal(spark, sf_dir):
    rows = rollups.diurnal(quakes(spark, sf_dir))
    return rounded(terajoules(rows, "total_energy_joules", "total_energy_tj"), avg_magnitude=9)


@query("e10_pager", oracle(f"""
SELECT alert_level, tsunami_flag, count(*) AS event_count, {_MEAN}, {_MAX},
       CAST(sum(felt_reports) AS BIGINT) AS total_felt
FROM quakes GROUP BY 1, 2"""))
def pager(spark, sf_dir):
    return rounded(rollups.pager(quakes(spark, sf_dir)), avg_magnitude=9)


_SLICE = "mag10 >= 25 AND depth_km BETWEEN 0 AND 300 AND region = 'JAPAN'"
_KPI = """count(*) AS events, coalesce(max(magnitude), 0) AS peak_magnitude,
       coalesce(round(avg(depth_km), 9), 0) AS avg_depth_km,
       CAST(coalesce(sum(tsunami_flag), 0) AS BIGINT) AS tsunami_alerts"""


@query("e11_kpis", oracle(f"SELECT {_KPI} FROM quakes WHERE {_SLICE}"))
def kpis(spark, sf_dir):
    rows = filters.slice_quakes(quakes(spark, sf_dir), 2.5, (0, 300), "JAPAN")
    return rounded(rollups.kpis(rows), avg_depth_km=9)


@query("e11_kpis_empty", oracle(f"SELECT {_KPI} FROM quakes WHERE region = 'NOWHERE'"))
def kpis_empty(spark, sf_dir):
    rows = filters.slice_quakes(quakes(spark, sf_dir), 0, (0, 700), "NOWHERE")
    return rounded(rollups.kpis(rows), avg_depth_km=9)


@query("e12_hourly_counts", oracle(
    f"SELECT {_window_sql('hour')} AS hour, count(*) AS count FROM quakes WHERE {_SLICE} GROUP BY 1"))
def hourly_counts(spark, sf_dir):
    rows = filters.slice_quakes(quakes(spark, sf_dir), 2.5, (0, 300), "JAPAN")
    return as_text(rollups.hourly_counts(rows), "hour")


_LEVELS = "levels(alert_level) AS (VALUES ('green'), ('yellow'), ('orange'), ('red'))"


@query("e13_alert_counts", oracle("""
SELECT alert_level, count(event_id) AS event_count
FROM levels LEFT JOIN quakes USING (alert_level) GROUP BY 1""", _LEVELS))
def alert_counts(spark, sf_dir):
    return rollups.alert_counts(filters.alerted(quakes(spark, sf_dir)))


@query("e14_alert_tsunami_pivot", oracle("""
SELECT alert_level, count(*) FILTER (tsunami_flag = 0) AS no_tsunami,
       count(*) FILTER (tsunami_flag = 1) AS tsunami
FROM levels LEFT JOIN quakes USING (alert_level) GROUP BY 1""", _LEVELS))
def alert_pivot(spark, sf_dir):
    return rollups.alert_tsunami_pivot(quakes(spark, sf_dir))


_GRID = """grid AS (
  SELECT CAST(h AS INTEGER) AS hour_of_day, CAST(d AS INTEGER) AS day_idx, count(event_id) AS n
  FROM range(24) hours(h) CROSS JOIN range(7) days(d)
  LEFT JOIN quakes ON hour(event_time) = h AND isodow(event_time) - 1 = d GROUP BY 1, 2)"""


@query("e15_hour_day_grid", oracle(
    "SELECT hour_of_day, " + ", ".join(
        f"CAST(sum(n) FILTER (day_idx = {i}) AS BIGINT) AS {day}"
        for i, day in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))
    ) + " FROM grid GROUP BY 1", _GRID))
def hour_day_grid(spark, sf_dir):
    return rollups.hour_day_grid(quakes(spark, sf_dir))


@query("e15_day_hour_grid", oracle(
    "SELECT CAST(isodow(event_time) - 1 AS INTEGER) AS day_idx, dayname(event_time) AS day_of_week, "
    + ", ".join(f"count(*) FILTER (hour(event_time) = {h}) AS h{h:02d}" for h in range(24))
    + " FROM quakes GROUP BY 1, 2"))
def day_hour_grid(spark, sf_dir):
    return rollups.day_hour_grid(quakes(spark, sf_dir))


@query("e16_hour_totals", oracle("""
SELECT hour_of_day, CAST(sum(n) AS BIGINT) AS total_events,
       round((SELECT CAST(sum(n) AS DOUBLE) / 24 FROM grid), 6) AS mean_hourly
FROM grid GROUP BY 1""", _GRID))
def hour_totals(spark, sf_dir):
    return rounded(rollups.hour_totals(quakes(spark, sf_dir)), mean_hourly=6)


@query("e16_hot_cells", oracle("""
SELECT hour_of_day, day_idx, n AS event_count, n > (SELECT avg(n) FROM grid) * 1.15 AS hot
FROM grid""", _GRID))
def hot_cells(spark, sf_dir):
    return rollups.hot_cells(quakes(spark, sf_dir))


@query("e20_regions", oracle("SELECT DISTINCT region FROM quakes"))
def regions(spark, sf_dir):
    return rollups.regions(quakes(spark, sf_dir))


@query("e23_region_hourly", oracle(f"""
SELECT region, {_window_sql('hour')} AS hour_window, count(*) AS event_count, {_MEAN}
FROM quakes GROUP BY 1, 2"""))
def region_hourly(spark, sf_dir):
    rows = rollups.region_hourly(quakes(spark, sf_dir))
    return as_text(rounded(rows, avg_magnitude=9), "hour_window")


@query("e24_region_alerts", oracle(f"""
SELECT region, {_MAX}, count(*) FILTER (alert_level = 'green') AS green_count,
       count(*) FILTER (alert_level = 'yellow') AS yellow_count,
       count(*) FILTER (alert_level = 'orange') AS orange_count,
       count(*) FILTER (alert_level = 'red') AS red_count
FROM quakes GROUP BY 1"""))
def region_alerts(spark, sf_dir):
    return rollups.region_alerts(quakes(spark, sf_dir))


@query("e26_corpus", oracle(f"SELECT count(*) AS events, {_MAX} FROM quakes"))
def corpus(spark, sf_dir):
    return rollups.corpus(quakes(spark, sf_dir))
