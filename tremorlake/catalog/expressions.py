"""Scalar expressions, one row per event."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..functions.measures import MAP_SIZE, SCATTER_SIZE, TIMELINE_SIZE
from ..functions.sql_functions import register_sql_functions
from ..sources.events_view import quakes
from .registry import oracle, query


def region_sql(rules):
    """The rules as a table of (rank, pattern, region); the first matching one decides."""
    rows = []
    for rule in rules.rules:
        patterns = [*rule.words, *([rf"\b{rule.token}\b"] if rule.token else [])]
        rows += [f"({len(rows) + i}, '{p}', '{rule.region}')" for i, p in enumerate(patterns)]
    text = "upper(place)" if rules.ignore_case else "place"
    return f"""
SELECT event_id, coalesce(arg_min(rule.region, rank), 'GLOBAL_OTHER') AS region
FROM quakes LEFT JOIN (VALUES {", ".join(rows)}) rule(rank, pattern, region)
  ON regexp_matches({text}, pattern)
GROUP BY event_id"""


@query("c1a_classify_region", oracle(region_sql(fn.FULL17)))
def regions_full(spark, sf_dir):
    return quakes(spark, sf_dir).select("event_id", fn.classify_region("place").alias("region"))


@query("c1b_classify_region_warehouse", oracle(region_sql(fn.WAREHOUSE12)))
def regions_warehouse(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id", fn.classify_region("place", fn.WAREHOUSE12).alias("region")
    )


@query("c1c_classify_region_document", oracle(region_sql(fn.DOCUMENT6)))
def regions_document(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id", fn.classify_region("place", fn.DOCUMENT6).alias("region")
    )


@query("c2_seismic_energy", oracle(
    "SELECT event_id, round(log10(energy), 9) AS log10_joules FROM quakes"))
def energy(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id", F.round(F.log10(fn.seismic_energy("magnitude")), 9).alias("log10_joules")
    )


@query("c3_depth_class", oracle("""
SELECT event_id,
  CASE WHEN depth_km < 35 THEN 'Shallow (0-35 km)' WHEN depth_km <= 150
       THEN 'Intermediate (35-150 km)' ELSE 'Deep (150-700 km)' END AS short_label,
  CASE WHEN depth_km < 35 THEN 'Shallow (0-35 km) - High Crustal Risk' WHEN depth_km <= 150
       THEN 'Intermediate (35-150 km) - Subduction Zone'
       ELSE 'Deep (150-700 km) - Mantle Transition' END AS long_label
FROM quakes"""))
def depth_classes(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id",
        fn.depth_class("depth_km").alias("short_label"),
        fn.depth_class("depth_km", fn.DEPTH_LONG).alias("long_label"),
    )


def _buckets(name, *units):
    columns = ", ".join(
        f"strftime(CAST(date_trunc('{u}', event_time) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {u}_window"
        for u in units
    )

    @query(name, oracle(f"SELECT event_id, {columns} FROM quakes"))
    def run(spark, sf_dir):
        return quakes(spark, sf_dir).select("event_id", *[
            F.date_format(fn.bucket("event_time", unit), "yyyy-MM-dd HH:mm:ss").alias(f"{unit}_window")
            for unit in units
        ])


_buckets("c4_time_buckets", "hour", "day", "month")
_buckets("c5_week_bucket", "week")


@query("c6_calendar_parts", oracle("""
SELECT event_id, CAST(isodow(event_time) - 1 AS INTEGER) AS day_idx,
  dayname(event_time) AS day_of_week, CAST(hour(event_time) AS INTEGER) AS hour_of_day
FROM quakes"""))
def calendar_parts(spark, sf_dir):
    return quakes(spark, sf_dir).select("event_id", *fn.calendar("event_time"))


@query("c7_epoch_to_time", oracle("""
SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%g') AS event_time, dt FROM quakes"""))
def epoch_to_time(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id",
        F.date_format(fn.event_time("epoch_millis"), "yyyy-MM-dd HH:mm:ss.SSS").alias("event_time"),
        fn.event_date("epoch_millis").alias("dt"),
    )


@query("c8_row_key", oracle("""
SELECT event_id, region || '#' || lpad(CAST(9223372036854775807 - epoch_millis AS VARCHAR), 19, '0')
  AS row_key FROM quakes"""))
def row_keys(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id", fn.row_key("region", "epoch_millis").alias("row_key")
    )


@query("c9_place_tail", oracle(
    "SELECT event_id, trim(string_split(place, ',')[-1]) AS label FROM quakes"))
def place_tails(spark, sf_dir):
    return quakes(spark, sf_dir).select("event_id", fn.place_tail("place").alias("label"))


def _size_sql(a, b, m0, p, lo, hi):
    # The base is kept at zero where the first arm decides anyway.
    return (f"CASE WHEN magnitude < {m0} THEN {lo} ELSE greatest(least({a}::DOUBLE + {b}::DOUBLE * "
            f"pow(greatest(magnitude - {m0}::DOUBLE, 0), {p}::DOUBLE), {hi}), {lo}) END")


@query("c10_display_size", oracle(f"""
SELECT event_id, round(({_size_sql(12, 8, 4.8, 1.6, 12, 220)})::DOUBLE, 6) AS map_size,
  round(({_size_sql(35, 25, 6.2, 1.4, 35, 180)})::DOUBLE, 6) AS timeline_size,
  round(({_size_sql(0, 18, 4.5, 1.4, 18, 260)})::DOUBLE, 6) AS scatter_size
FROM quakes"""))
def display_sizes(spark, sf_dir):
    specs = {"map_size": MAP_SIZE, "timeline_size": TIMELINE_SIZE, "scatter_size": SCATTER_SIZE}
    return quakes(spark, sf_dir).select("event_id", *[
        F.round(fn.display_size("magnitude", spec), 6).alias(name) for name, spec in specs.items()
    ])


@query("c11_bands", oracle("""
SELECT event_id,
  CASE WHEN mag10 < 30 THEN 'minor' WHEN mag10 < 45 THEN 'moderate' WHEN mag10 < 60 THEN 'strong'
       ELSE 'major' END AS severity,
  CASE WHEN mag10 BETWEEN 50 AND 59 THEN '5-6' WHEN mag10 BETWEEN 60 AND 69 THEN '6-7'
       WHEN mag10 BETWEEN 70 AND 90 THEN '7-9' END AS alert_band
FROM quakes"""))
def bands(spark, sf_dir):
    return quakes(spark, sf_dir).select(
        "event_id",
        fn.severity_band("magnitude").alias("severity"),
        fn.alert_band("magnitude").alias("alert_band"),
    )


@query("c12_units", oracle("""
SELECT region, round(sum(energy) / 1e15, 6) AS petajoules, round(log10(count(*)), 9) AS log10_count,
  round(CAST(sum(strlen(coalesce(place, ''))) AS DOUBLE) / 1048576, 2) AS place_mb
FROM quakes GROUP BY region"""))
def units(spark, sf_dir):
    return quakes(spark, sf_dir).groupBy("region").agg(
        F.round(fn.petajoules(F.sum("seismic_energy_joules")), 6).alias("petajoules"),
        F.round(F.log10(F.count(F.lit(1))), 9).alias("log10_count"),
        fn.megabytes(F.sum(F.octet_length(F.coalesce("place", F.lit(""))))).alias("place_mb"),
    )


@query("i_sql_functions", oracle("""
SELECT event_id, quakes.region, warehouse.region AS warehouse_region,
  document.region AS document_region, round(log10(energy), 9) AS log10_joules,
  CASE WHEN depth_km < 35 THEN 'Shallow (0-35 km)' WHEN depth_km <= 150
       THEN 'Intermediate (35-150 km)' ELSE 'Deep (150-700 km)' END AS depth,
  quakes.region || '#' || (9223372036854775807 - epoch_millis) AS row_key
FROM quakes JOIN warehouse USING (event_id) JOIN document USING (event_id)""",
    f"warehouse AS ({region_sql(fn.WAREHOUSE12)})", f"document AS ({region_sql(fn.DOCUMENT6)})"))
def sql_functions(spark, sf_dir):
    q = quakes(spark, sf_dir)
    register_sql_functions(spark)
    return q.selectExpr(
        "event_id",
        "classify_region(place) AS region",
        "classify_region_warehouse(place) AS warehouse_region",
        "classify_region_document(place) AS document_region",
        "round(log10(seismic_energy(magnitude)), 9) AS log10_joules",
        "depth_class(depth_km) AS depth",
        "seismic_row_key(region, epoch_millis) AS row_key",
    )
