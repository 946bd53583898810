"""Sources and sinks: each query writes what it derived from the tables and reads it back."""

from functools import reduce

from pyspark.sql import functions as F

from .. import schemas
from ..operators import cleansing, rollups
from ..plans import cube, warehouse
from ..plans.batch import write_rollups
from ..session import workspace
from ..sources import compaction as compaction_
from ..sources import footprint, readers, writers
from ..sources.events_view import features, quakes
from .registry import oracle, query, rounded, terajoules

LANDED_AT = "2024-02-01 05:06:07"


def flat(rows):
    p = "properties."
    return rows.select(
        "id",
        *[F.col(p + c).alias(c) for c in ("mag", "place", "time", "updated", "felt", "alert",
                                          "tsunami", "sig", "magType")],
        *[F.get("geometry.coordinates", F.lit(i)).alias(c)
          for i, c in enumerate(("longitude", "latitude", "depth_km"))],
    )


FLAT_SQL = ("SELECT id, mag, place, time, updated, felt, alert, tsunami, sig, magType, longitude, "
            "latitude, depth_km FROM raw")


@query("a1_feature_collections", oracle(FLAT_SQL))
def collections(spark, sf_dir):
    path = workspace(spark, "a1")
    writers.land_features(features(spark, sf_dir), path, LANDED_AT)
    return flat(readers.read_feature_collections(spark, path))


@query("a2_feature_lines", oracle(FLAT_SQL))
def lines(spark, sf_dir):
    path = workspace(spark, "a2")
    writers.land_features(features(spark, sf_dir), path, LANDED_AT, "lines")
    return flat(readers.read_features_ndjson(spark, path))


@query("a3_landing", oracle("""
SELECT form, '2024' AS "YYYY", '02' AS "MM", '01' AS "DD", '05' AS "HH", count(*) AS features,
       count(DISTINCT id) AS ids
FROM raw, (VALUES ('documents'), ('lines')) forms(form) GROUP BY form"""))
def landing(spark, sf_dir):
    parts = []
    for form in ("documents", "lines"):
        path = workspace(spark, f"a3-{form}")
        writers.land_features(features(spark, sf_dir), path, LANDED_AT, form)
        landed = readers.read_landed(spark, path, form)
        parts.append(
            landed.groupBy(F.lit(form).alias("form"), *schemas.LANDING_KEYS).agg(
                F.count(F.lit(1)).alias("features"), F.countDistinct("id").alias("ids")
            )
        )
    return parts[0].unionByName(parts[1])


_DAYS = """SELECT dt, count(*) AS events, round(avg(magnitude), 9) AS avg_magnitude,
       CAST(sum(felt_reports) AS BIGINT) AS felt, round(sum(energy) / 1e12, 3) AS energy_tj
FROM quakes GROUP BY dt"""


def _days(rows):
    out = rows.groupBy("dt").agg(
        F.count(F.lit(1)).alias("events"), F.avg("magnitude").alias("avg_magnitude"),
        F.sum("felt_reports").alias("felt"), F.sum("seismic_energy_joules").alias("energy"),
    )
    return rounded(terajoules(out, "energy", "energy_tj"), avg_magnitude=9)


@query("a4_parquet", oracle(_DAYS))
def parquet(spark, sf_dir):
    path = workspace(spark, "a4")
    writers.write_quakes(quakes(spark, sf_dir), path)
    return _days(spark.read.schema(schemas.QUAKES).parquet(path))


@query("a5_csv", oracle(
    "SELECT event_id, magnitude, place, region, epoch_millis, depth_km, felt_reports, "
    "alert_level, dt FROM quakes"))
def csv(spark, sf_dir):
    path = workspace(spark, "a5")
    writers.write_quakes(quakes(spark, sf_dir), path, "csv")
    return readers.read_quakes(spark, path, "csv").select(
        "event_id", "magnitude", "place", "region", "epoch_millis", "depth_km", "felt_reports",
        "alert_level", "dt",
    )


@query("a6_orc_dynamic_overwrite", oracle("""
SELECT dt, count(*) AS events, CAST(sum(CASE WHEN dt >= '2024-01-15' THEN felt_reports ELSE -1 END)
       AS BIGINT) AS felt FROM quakes GROUP BY dt"""))
def orc(spark, sf_dir):
    """Every day is written, then the days from the fifteenth on again with their reports."""
    path = workspace(spark, "a6")
    rows = quakes(spark, sf_dir)
    writers.write_quakes(rows.withColumn("felt_reports", F.lit(-1)), path, "orc")
    writers.write_quakes(readers.catalog_window(rows, "2024-01-15"), path, "orc")
    written = spark.read.schema(schemas.QUAKES).orc(path)
    return written.groupBy("dt").agg(
        F.count(F.lit(1)).alias("events"), F.sum("felt_reports").alias("felt")
    )


@query("a6_sql_insert_overwrite", oracle("""
SELECT dt, count(*) AS events, CAST(sum(CASE WHEN dt >= '2024-01-15' THEN felt_reports ELSE -1 END)
       AS BIGINT) AS felt FROM quakes GROUP BY dt"""))
def insert_overwrite(spark, sf_dir):
    """As the query above, by SQL into a partitioned table."""
    path = workspace(spark, "a6-table")
    name = "processed_" + path.rpartition("-")[2]
    warehouse.register(quakes(spark, sf_dir))
    columns = ", ".join(c for c in schemas.QUAKES.fieldNames() if c != "dt")
    warehouse.create_table(spark, name, path)
    early = columns.replace("felt_reports", "-1 AS felt_reports")
    warehouse.overwrite_days(spark, name, f"SELECT {early}, dt FROM {warehouse.VIEW}")
    warehouse.overwrite_days(
        spark, name, f"SELECT {columns}, dt FROM {warehouse.VIEW} WHERE dt >= '2024-01-15'")
    return spark.table(name).groupBy("dt").agg(
        F.count(F.lit(1)).alias("events"), F.sum("felt_reports").alias("felt")
    )


@query("a7_tsv", oracle("""
SELECT id AS event_id, mag AS magnitude, place, time AS epoch_millis, longitude, latitude, depth_km,
       felt AS felt_reports, alert AS alert_level, tsunami AS tsunami_flag
FROM raw WHERE mag10 >= 10"""))
def tsv(spark, sf_dir):
    path = workspace(spark, "a7")
    rows = cleansing.quality_filter(cleansing.flatten(features(spark, sf_dir), "cleansed"))
    writers.write_tsv(rows, path)
    return spark.read.schema(schemas.CLEANSED).option("sep", "\t").csv(path)


@query("a8_rollup_exports", oracle("""
SELECT 'hourly_activity' AS rollup, count(DISTINCT date_trunc('hour', event_time)) AS rows, count(*) AS events FROM quakes
UNION ALL SELECT 'daily_activity', count(DISTINCT dt), count(*) FROM quakes
UNION ALL SELECT 'monthly_activity', count(DISTINCT date_trunc('month', event_time)), count(*) FROM quakes
UNION ALL SELECT 'regional_summary', count(DISTINCT region), count(*) FROM quakes
UNION ALL SELECT 'depth_summary', count(DISTINCT CASE WHEN depth_km < 35 THEN 1 WHEN depth_km <= 150 THEN 2 ELSE 3 END), count(*) FROM quakes
UNION ALL SELECT 'diurnal_hourly_weekly', count(DISTINCT (isodow(event_time), hour(event_time))), count(*) FROM quakes
UNION ALL SELECT 'frequency_magnitude', count(DISTINCT t), count(*) FROM range(50, 84) x(t) JOIN quakes ON mag10 >= t
UNION ALL SELECT 'pager_tsunami_summary', count(DISTINCT (alert_level, tsunami_flag)), count(*) FROM quakes"""))
def exports(spark, sf_dir):
    """All eight rollups, written from one scan and read back."""
    layout = {
        "hourly_activity": schemas.activity_schema("hour"),
        "daily_activity": schemas.activity_schema("day"),
        "monthly_activity": schemas.activity_schema("month"),
        "regional_summary": schemas.REGIONAL,
        "depth_summary": schemas.DEPTH,
        "diurnal_hourly_weekly": schemas.DIURNAL,
        "frequency_magnitude": schemas.FREQUENCY,
        "pager_tsunami_summary": schemas.PAGER,
    }
    root = workspace(spark, "a8")
    write_rollups(quakes(spark, sf_dir), f"{root}/cube", root)
    parts = []
    for name in layout:
        table = readers.read_rollup(spark, f"{root}/{name}", layout[name])
        count = next(c for c in table.columns if c in ("total_events", "event_count", "cumulative_count"))
        parts.append(table.agg(
            F.lit(name).alias("rollup"), F.count(F.lit(1)).alias("rows"), F.sum(count).alias("events")
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("e5a_regional_scorecard_from_cube", oracle("""
SELECT region, count(*) AS event_count, round(avg(magnitude), 9) AS avg_magnitude,
       max(magnitude) AS max_magnitude, round(avg(depth_km), 9) AS avg_depth_km,
       CAST(sum(tsunami_flag) AS BIGINT) AS tsunami_warnings,
       CAST(sum(felt_reports) AS BIGINT) AS total_felt_reports,
       round(sum(energy) / 1e12, 3) AS cumulative_energy_tj
FROM quakes GROUP BY region"""))
def scorecard_from_cube(spark, sf_dir):
    rows = cube.regional_scorecard(cube.build(quakes(spark, sf_dir)))
    rows = terajoules(rows, "cumulative_energy_joules", "cumulative_energy_tj")
    return rounded(rows, avg_magnitude=9, avg_depth_km=9)


@query("e8_frequency_magnitude_from_cube", oracle("""
SELECT t / CAST(10 AS DOUBLE) AS magnitude, count(*) AS cumulative_count,
       round(log10(count(*)), 9) AS log10_count
FROM range(50, 84) thresholds(t) JOIN quakes ON mag10 >= t GROUP BY t"""))
def frequency_from_cube(spark, sf_dir):
    return rounded(cube.frequency_magnitude(cube.build(quakes(spark, sf_dir))), log10_count=9)


@query("a9_json_summary", oracle("""
SELECT count(*) AS events, max(magnitude) AS peak_magnitude, round(avg(depth_km), 9) AS avg_depth_km,
       CAST(sum(tsunami_flag) AS BIGINT) AS tsunami_alerts FROM quakes"""))
def summary(spark, sf_dir):
    path = workspace(spark, "a9")
    writers.write_summary(rollups.kpis(quakes(spark, sf_dir)), path)
    layout = schemas.table(
        "events bigint, peak_magnitude double, avg_depth_km double, tsunami_alerts bigint"
    )
    return rounded(spark.read.schema(layout).json(path), avg_depth_km=9)


@query("a10_read_processed", oracle("""
SELECT event_id, epoch_millis, strftime(event_time, '%Y-%m-%d %H:%M:%S.%g') AS dt_utc, dt FROM quakes"""))
def processed(spark, sf_dir):
    path = workspace(spark, "a10")
    writers.write_quakes(quakes(spark, sf_dir), path)
    return readers.read_quakes(spark, path).select(
        "event_id", "epoch_millis",
        F.date_format("dt_utc", "yyyy-MM-dd HH:mm:ss.SSS").alias("dt_utc"), "dt",
    )


@query("a11_read_rollup", oracle("""
SELECT region, count(*) AS event_count, round(avg(magnitude), 9) AS avg_magnitude,
       CAST(sum(felt_reports) AS BIGINT) AS total_felt_reports FROM quakes GROUP BY region"""))
def rollup(spark, sf_dir):
    path = workspace(spark, "a11")
    writers.export_rollup(rollups.regional_scorecard(quakes(spark, sf_dir)), path, ["region"])
    rows = readers.read_rollup(spark, path, schemas.REGIONAL)
    return rounded(
        rows.select("region", "event_count", "avg_magnitude", "total_felt_reports"), avg_magnitude=9
    )


@query("a13_compaction", oracle(_DAYS))
def compaction(spark, sf_dir):
    """The feed is delivered twice; the compacted days hold each event once."""
    landed, path = workspace(spark, "a13-landed"), workspace(spark, "a13")
    for hour in ("05", "06"):
        writers.land_features(features(spark, sf_dir), landed, f"2024-02-01 {hour}:00:00")
    writers.compact(spark, landed, path)
    return _days(spark.read.schema(schemas.QUAKES).parquet(path))


@query("a13_new_hours", oracle(_DAYS))
def fold_hours(spark, sf_dir):
    """Half of the events, then all of them as updated, then an earlier hour that comes late with
    old copies: three runs, each over the hours that the runs before had not folded."""
    landed, path = workspace(spark, "a13-hours"), workspace(spark, "a13-days")
    rows = features(spark, sf_dir)
    props = F.col("properties")
    old = rows.withColumn("properties", props.withField("mag", props["mag"] + 1).withField(
        "updated", props["updated"] - 1000))
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for hour, delivered in (("05", old.filter(half)), ("06", rows), ("04", old)):
        writers.land_features(delivered, landed, f"2024-02-01 {hour}:00:00", "lines")
        compaction_.fold(spark, landed, path)
    return _days(compaction_.compacted(spark, path))


@query("a14_storage_footprint")
def storage(spark, sf_dir):
    """Measured bytes; they depend on the writers, so there is no SQL to compare with."""
    root, rows = workspace(spark, "a14"), quakes(spark, sf_dir)
    writers.land_features(features(spark, sf_dir), f"{root}/raw", LANDED_AT)
    for fmt in ("parquet", "orc", "csv"):
        writers.write_quakes(rows, f"{root}/{fmt}", fmt)
    return footprint.storage_footprint(spark, root)


@query("a14_storage_facts", """
SELECT format, true AS has_files, true AS within_raw, true AS savings_agree
FROM (VALUES ('json'), ('parquet'), ('orc'), ('csv')) formats(format)""")
def storage_facts(spark, sf_dir):
    """What holds of the measured bytes whatever the writers do."""
    sizes = storage(spark, sf_dir)
    raw = sizes.filter("format = 'json'").agg(F.max("bytes")).scalar()
    return sizes.select(
        "format", (F.col("files") > 0).alias("has_files"),
        (F.col("bytes") <= raw).alias("within_raw"),
        (F.col("savings_percent") == F.round((1 - F.col("bytes") / raw) * 100, 1))
        .alias("savings_agree"),
    )


@query("a15_catalog_windows", oracle("""
SELECT w AS catalog, count(*) AS events, min(epoch_millis) AS first, max(epoch_millis) AS last FROM (
  SELECT 'major_2020_2024' AS w, epoch_millis FROM quakes WHERE mag10 >= 50 AND event_time >= '2020-01-01' AND event_time <= '2024-12-31'
  UNION ALL SELECT 'hour', epoch_millis FROM quakes WHERE event_time BETWEEN '2024-01-19 23:00' AND '2024-01-20'
  UNION ALL SELECT 'day', epoch_millis FROM quakes WHERE event_time BETWEEN '2024-01-19' AND '2024-01-20'
  UNION ALL SELECT 'week', epoch_millis FROM quakes WHERE event_time BETWEEN '2024-01-13' AND '2024-01-20'
  UNION ALL SELECT 'january', epoch_millis FROM quakes WHERE mag10 >= 30 AND event_time BETWEEN '2024-01-05' AND '2024-01-25')
GROUP BY 1"""))
def windows(spark, sf_dir):
    q = quakes(spark, sf_dir)
    chosen = {name: readers.past(q, "2024-01-20", name) for name in readers.LIVE_WINDOWS}
    chosen["major_2020_2024"] = readers.catalog_preset(q, "major_2020_2024")
    chosen["january"] = readers.catalog_window(q, "2024-01-05", "2024-01-25", 3.0)
    parts = [
        rows.groupBy(F.lit(name).alias("catalog")).agg(
            F.count(F.lit(1)).alias("events"), F.min("epoch_millis").alias("first"),
            F.max("epoch_millis").alias("last"),
        )
        for name, rows in chosen.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("a15_catalog_jul_oct", oracle(
    "SELECT event_id, magnitude FROM quakes WHERE mag10 >= 30 AND event_time >= '2024-07-01' "
    "AND event_time <= '2024-10-31'"))
def jul_oct(spark, sf_dir):
    return readers.catalog_preset(quakes(spark, sf_dir), "jul_oct_2024").select(
        "event_id", "magnitude"
    )
