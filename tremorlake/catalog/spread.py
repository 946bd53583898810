"""Windows, long buckets and spikes over events of seven years, and selections pushed to files.

The given events span a month, which no window of the catalogue cuts; here they are moved by
whole steps of thirty days.
"""

from pyspark.sql import functions as F

from ..operators import filters, rollups, serving, statistics
from ..session import workspace
from ..sources import clustered, readers, writers
from ..sources.events_view import SPREAD_STEP, quakes
from .registry import as_text, oracle, query, rounded, terajoules

_MOVED = f"""moved AS (
  SELECT * REPLACE (make_timestamp(epoch_millis * 1000) AS event_time,
                    strftime(make_timestamp(epoch_millis * 1000), '%Y-%m-%d') AS dt)
  FROM (SELECT * REPLACE (epoch_millis + (CAST(substr(event_id, 2) AS BIGINT) * 37 % 84 - 61)
                          * {SPREAD_STEP} AS epoch_millis) FROM quakes))"""
_WINDOW = """mag10 >= 50 AND event_time BETWEEN TIMESTAMP '2020-01-01'
  AND TIMESTAMP '2024-12-31 23:59:59'"""


def _written(spark, sf_dir):
    """The month as files, so that selections reach their folders and statistics."""
    path = workspace(spark, "written")
    writers.write_quakes(quakes(spark, sf_dir), path)
    return readers.read_quakes(spark, path)


@query("d2_major_in_window_spread", oracle(
    f"SELECT event_id, magnitude, epoch_millis FROM moved WHERE {_WINDOW}", _MOVED))
def major_in_window(spark, sf_dir):
    rows = filters.major_in_window(quakes(spark, sf_dir, spread=True))
    return rows.select("event_id", "magnitude", "epoch_millis")


@query("a15_catalog_presets_spread", oracle("""
SELECT 'jul_oct_2024' AS preset, event_id, epoch_millis FROM moved
WHERE mag10 >= 30 AND event_time >= '2024-07-01' AND event_time <= '2024-10-31'
UNION ALL SELECT 'major_2020_2024', event_id, epoch_millis FROM moved
WHERE mag10 >= 50 AND event_time >= '2020-01-01' AND event_time <= '2024-12-31'""", _MOVED))
def presets(spark, sf_dir):
    table = quakes(spark, sf_dir, spread=True)
    parts = [
        readers.catalog_preset(table, name).select(
            F.lit(name).alias("preset"), "event_id", "epoch_millis")
        for name in readers.CATALOG_PRESETS
    ]
    return parts[0].unionByName(parts[1])


@query("d1_slice_written", oracle("""
SELECT event_id, magnitude, depth_km FROM quakes
WHERE mag10 >= 25 AND depth_km BETWEEN 35 AND 300 AND region = 'CALIFORNIA'"""))
def slice_written(spark, sf_dir):
    rows = filters.slice_quakes(_written(spark, sf_dir), 2.5, (35, 300), "CALIFORNIA")
    return rows.select("event_id", "magnitude", "depth_km")


@query("d1_slice_clustered", oracle("""
SELECT event_id, magnitude, depth_km FROM quakes
WHERE mag10 >= 45 AND depth_km BETWEEN 70 AND 300"""))
def slice_clustered(spark, sf_dir):
    path = workspace(spark, "clustered")
    clustered.write_clustered(_written(spark, sf_dir), path)
    rows = filters.slice_quakes(spark.read.parquet(path), 4.5, (70, 300))
    return rows.select("event_id", "magnitude", "depth_km")


@query("h1a_latest_written", oracle("""
SELECT event_id, magnitude, depth_km, alert_level FROM quakes WHERE region = 'CALIFORNIA'
ORDER BY epoch_millis DESC, event_id LIMIT 10"""))
def latest_written(spark, sf_dir):
    return serving.latest(_written(spark, sf_dir), "CALIFORNIA").select(
        "event_id", "magnitude", "depth_km", "alert_level")


def _bucketed(name, unit, sql_where, rows_of):
    @query(name, oracle(f"""
SELECT strftime(CAST(date_trunc('{unit}', event_time) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {unit}_window,
       count(*) AS total_events, round(sum(energy) / 1e12, 3) AS total_energy_tj
FROM moved WHERE {sql_where} GROUP BY 1""", _MOVED))
    def run(spark, sf_dir):
        rows = rows_of(quakes(spark, sf_dir, spread=True))
        rows = terajoules(rows, "total_energy_joules", "total_energy_tj")
        window = f"{unit}_window"
        return as_text(rows.select(window, "total_events", "total_energy_tj"), window)


_bucketed("e3_monthly_activity_spread", "month", "true", lambda q: rollups.activity(q, "month"))
_bucketed("e4_weekly_activity_spread", "week", _WINDOW,
          lambda q: rollups.weekly_energy(filters.major_in_window(q)))


@query("e19_weekly_spikes_spread", oracle("""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS week_window, n AS total_events,
       round(m + 1.8::DOUBLE * s, 6) AS threshold, n > m + 1.8::DOUBLE * s AS is_spike
FROM counted, (SELECT avg(n) AS m, stddev_samp(n) AS s FROM counted)""", _MOVED,
    f"""counted AS (SELECT CAST(date_trunc('week', event_time) AS TIMESTAMP) AS w, count(*) AS n
  FROM moved WHERE {_WINDOW} GROUP BY 1)"""))
def weekly_spikes(spark, sf_dir):
    found = statistics.spikes(
        filters.major_in_window(quakes(spark, sf_dir, spread=True)), "week", 1.8)
    return as_text(rounded(found.drop("mean_events")), "week_window")
