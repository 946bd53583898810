"""The warehouse queries as Spark SQL over temporary views.

``register`` names a raw-feature frame and a processed frame for SQL users and creates the
SQL functions the texts call.
"""

from ..functions.sql_functions import register_sql_functions
from ..operators.cleansing import processed_columns
from ..schemas import QUAKES

RAW_VIEW = "quake_features"
VIEW = "quakes"

# Measures by name, shared by the grouped queries.
_MEASURES = {
    "total_events": "count(*)",
    "event_count": "count(*)",
    "avg_magnitude": "round(avg(magnitude), 2)",
    "max_magnitude": "max(magnitude)",
    "avg_depth_km": "round(avg(depth_km), 1)",
    "tsunami_warning_count": "sum(tsunami_flag)",
    "total_felt_reports": "sum(felt_reports)",
    "total_energy_joules": "sum(seismic_energy_joules)",
    "cumulative_energy_joules": "round(sum(seismic_energy_joules), 2)",
}


def _columns(columns):
    return ",\n       ".join(columns)


def _grouped(key, name, measures, order):
    picked = [f"{_MEASURES[m]} AS {m}" for m in measures.split()]
    listed = _columns([f"{key} AS {name}", *picked])
    return f"SELECT {listed}\nFROM {VIEW} GROUP BY {key} ORDER BY {order}"


ETL = f"""SELECT {_columns(processed_columns(full=False))}
FROM {RAW_VIEW} WHERE length(id) > 0 AND properties.mag IS NOT NULL"""

HOURLY = _grouped(
    "date_format(date_trunc('HOUR', event_time), 'yyyy-MM-dd HH:mm:ss')", "hour_window",
    "total_events avg_magnitude max_magnitude total_energy_joules", "hour_window DESC")

SCORECARD = _grouped(
    "region", "region",
    "event_count avg_magnitude max_magnitude avg_depth_km tsunami_warning_count "
    "total_felt_reports cumulative_energy_joules", "event_count DESC, region")

DEPTH = _grouped(
    "depth_class_long(depth_km)", "depth_classification",
    "event_count avg_magnitude max_magnitude", "depth_classification")

LATEST = f"""
SELECT event_id, magnitude, place, depth_km, event_time, alert_level
FROM {VIEW} WHERE region = :region
ORDER BY epoch_millis DESC, event_id LIMIT :n
"""


def create_table(spark, name, path, fmt="orc"):
    """The processed table for SQL users: partitioned by day, its files below ``path``."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUAKES)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt} "
        f"PARTITIONED BY (dt) LOCATION '{path}'"
    )


def overwrite_days(spark, name, select):
    """Replace the days that ``select`` brings and leave the others."""
    setting, mode = "spark.sql.sources.partitionOverwriteMode", "dynamic"
    before = spark.conf.get(setting)
    spark.conf.set(setting, mode)
    try:
        spark.sql(f"INSERT OVERWRITE {name} PARTITION (dt)\n{select}")
    finally:
        spark.conf.set(setting, before)


def register(quakes, features=None):
    spark = quakes.sparkSession
    register_sql_functions(spark)
    quakes.createOrReplaceTempView(VIEW)
    if features is not None:
        features.createOrReplaceTempView(RAW_VIEW)
    return spark


def latest(spark, region, n=10):
    return spark.sql(LATEST, args={"region": region, "n": n})
