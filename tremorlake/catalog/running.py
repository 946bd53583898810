"""Running totals, as-of lookup, rolling counts, top lists, samples."""

from pyspark.sql import functions as F

from ..operators import filters, ranking, running
from ..session import workspace
from ..sources.events_view import quakes
from ..sources.readers import past
from .registry import oracle, query, rounded


def _running_sql(where):
    return oracle(f"""
SELECT event_id, round(sum(energy) OVER w / 1e15, 3) AS cum_energy_pj, row_number() OVER w AS cum_events
FROM quakes WHERE {where} WINDOW w AS (ORDER BY epoch_millis, event_id ROWS UNBOUNDED PRECEDING)""")


def _staircase(rows):
    rows = rows.select("event_id", "epoch_millis", "seismic_energy_joules")
    out = running.running_energy(rows)
    return rounded(out.select("event_id", "cum_energy_pj", "cum_events"), cum_energy_pj=3)


@query("f1_running_energy_window", _running_sql("mag10 >= 50"))
def running_window(spark, sf_dir):
    return _staircase(filters.major_in_window(quakes(spark, sf_dir)))


@query("f1_running_energy_slice", _running_sql("mag10 >= 20 AND depth_km BETWEEN 0 AND 700"))
def running_slice(spark, sf_dir):
    return _staircase(filters.slice_quakes(quakes(spark, sf_dir), 2.0))


@query("f1_running_index", _running_sql("true"))
def running_index(spark, sf_dir):
    """Days appended in three runs, the last with events of every day that came late."""
    path, rows = workspace(spark, "f1-index"), quakes(spark, sf_dir)
    late = F.pmod(F.xxhash64("event_id"), F.lit(5)) == 0
    day = F.dayofmonth("event_time")
    for k, part in enumerate((~late & (day <= 15), ~late & (day > 15), late)):
        running.extend_index(rows.filter(part), path, k)
    return rounded(running.running_index(spark, path).select(
        "event_id", "cum_energy_pj", "cum_events"), cum_energy_pj=3)


@query("f2_event_number", oracle("""
SELECT event_id, row_number() OVER (ORDER BY epoch_millis, event_id) AS cum_events
FROM quakes WHERE mag10 >= 50"""))
def event_number(spark, sf_dir):
    rows = filters.major_in_window(quakes(spark, sf_dir)).select("event_id", "epoch_millis")
    return running.event_number(rows).select("event_id", "cum_events")


INSTANTS = ("2024-01-05", "2024-01-10 12:00:00", "2024-01-20", "2024-01-29 23:00:00")


@query("f3_first_at_or_after", oracle(
    "SELECT epoch_ms(t) AS instant_millis, q.epoch_millis, q.event_id, q.magnitude FROM ("
    "SELECT t, arg_min(quakes, epoch_millis) AS q FROM (VALUES "
    + ", ".join(f"(TIMESTAMP '{i}')" for i in INSTANTS)
    + ") instants(t) JOIN quakes ON epoch_millis >= epoch_ms(t) GROUP BY t)"))
def first_after(spark, sf_dir):
    rows = quakes(spark, sf_dir).select("epoch_millis", "event_id", "magnitude")
    return running.first_at_or_after(rows, INSTANTS)


@query("f4_rolling_counts", oracle("""
SELECT DISTINCT region, epoch_millis,
  count(*) OVER (PARTITION BY region ORDER BY epoch_millis RANGE BETWEEN 0 PRECEDING AND CURRENT ROW) AS events,
  count(*) OVER (PARTITION BY region ORDER BY epoch_millis RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS last_1h,
  count(*) OVER (PARTITION BY region ORDER BY epoch_millis RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS last_6h,
  count(*) OVER (PARTITION BY region ORDER BY epoch_millis RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS last_24h
FROM quakes"""))
def rolling(spark, sf_dir):
    return running.rolling_counts(quakes(spark, sf_dir))


@query("h3_top_places", oracle("""
SELECT place, magnitude, event_id, longitude, latitude, trim(string_split(place, ',')[-1]) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY mag10 DESC, event_id) AS r
      FROM quakes WHERE mag10 >= 50)
WHERE r = 1 ORDER BY magnitude DESC, event_id LIMIT 6"""))
def top_places(spark, sf_dir):
    return ranking.top_places(filters.major_or_all(quakes(spark, sf_dir)))


def _top_regions_sql(k, window="true"):
    return oracle(f"""
SELECT region, count(*) AS event_count, max(magnitude) AS max_magnitude FROM quakes
WHERE region <> 'GLOBAL_OTHER' AND {window} GROUP BY 1 ORDER BY event_count DESC, region LIMIT {k}""")


@query("h4_top_regions", _top_regions_sql(8))
def top_regions(spark, sf_dir):
    return ranking.top_regions(quakes(spark, sf_dir)).select(
        "region", "event_count", "max_magnitude"
    )


@query("h4_top_five_of_the_week", _top_regions_sql(
    5, "event_time BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'"))
def top_five(spark, sf_dir):
    recent = past(quakes(spark, sf_dir), "2024-01-20", "week")
    return ranking.top_regions(recent, 5).select(
        "region", "event_count", "max_magnitude"
    )


@query("h5_strata_sample", oracle("""
SELECT event_id, epoch_millis, magnitude, 'major' AS stratum FROM quakes WHERE mag10 >= 45
UNION ALL
SELECT * FROM (SELECT event_id, epoch_millis, magnitude, 'moderate' AS stratum FROM quakes
               WHERE mag10 < 45 ORDER BY md5('42:' || event_id), event_id LIMIT 1200)"""))
def strata_sample(spark, sf_dir):
    """Split low enough that the moderate stratum really has to be sampled."""
    rows = quakes(spark, sf_dir).select("event_id", "epoch_millis", "magnitude")
    return ranking.strata_sample(rows, split=4.5)
