"""Registration, shared rounding, and the SQL view of the input."""

from pyspark.sql import functions as F

from ..sources.events_view import ALERTS, PLACES

QUERIES = {}
ORACLES = {}

# Expected region of each place.
PLACE_REGIONS = (
    "CALIFORNIA", "CALIFORNIA", "ALASKA", "HAWAII", "JAPAN", "INDONESIA", "CHILE",
    "PHILIPPINES", "MEXICO", "NEW_ZEALAND", "PUERTO_RICO", "TURKEY", "SOUTH_PACIFIC", "TAIWAN",
    "ICELAND", "MEDITERRANEAN", "SOUTH_ATLANTIC", "CARIBBEAN", "GLOBAL_OTHER", "CALIFORNIA",
    "GLOBAL_OTHER",
)


def _text(value):
    return "NULL" if value is None else f"'{value}'"


_PLACE_ROWS = ", ".join(
    f"({i}, {_text(place)}, '{region}')"
    for i, (place, region) in enumerate(zip(PLACES, PLACE_REGIONS))
)
_ALERT_ARMS = " ".join(f"WHEN '{kind}' THEN '{level}'" for kind, level in ALERTS.items())

INPUT_SQL = f"""
places(pid, place, region) AS (VALUES {_PLACE_ROWS}),
parsed AS (
  SELECT *, 20 + CAST(floor(value / 8) AS BIGINT) AS mag10,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         epoch_us(ts) // 1000 AS ms
  FROM events),
raw AS (
  SELECT format('q{{:08d}}', event_id) AS id, mag10, mag10 / CAST(10 AS DOUBLE) AS mag, k,
         event_type, places.place, places.region, ms AS time, ms + k * 1000 AS updated,
         CASE WHEN event_type = 'view' THEN NULL ELSE k END AS felt,
         CASE event_type {_ALERT_ARMS} END AS alert,
         CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS tsunami,
         CAST(mag10 * 10 AS INTEGER) AS sig,
         CASE WHEN event_type = 'click' THEN NULL ELSE 'mww' END AS magType,
         CAST((event_id * 37) % 3600 AS DOUBLE) / 10 - 180 AS longitude,
         CAST((event_id * 53) % 1400 AS DOUBLE) / 10 - 60 AS latitude,
         CAST((event_id * 7919) % 7000 AS DOUBLE) / 10 AS depth_km
  FROM parsed JOIN places ON places.pid = user_id % 21),
quakes AS (
  SELECT id AS event_id, mag10, mag AS magnitude, place, region,
         make_timestamp(time * 1000) AS event_time, time AS epoch_millis, longitude, latitude,
         depth_km, coalesce(felt, 0) AS felt_reports, coalesce(alert, 'none') AS alert_level,
         tsunami AS tsunami_flag, sig AS significance,
         coalesce(magType, 'unknown') AS magnitude_type,
         pow(10.0::DOUBLE, 4.8::DOUBLE + 1.5::DOUBLE * mag) AS energy,
         strftime(make_timestamp(time * 1000), '%Y-%m-%d') AS dt, k, event_type
  FROM raw)
"""


def oracle(body, *more):
    """SQL text: the input as ``raw`` and ``quakes``, further named parts, then the query."""
    return "WITH " + ",\n".join([INPUT_SQL, *more]) + "\n" + body


def query(name, sql=None):
    """Register a function of (spark, sf_dir); ``sql`` is its oracle."""
    def add(function):
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return add


def rounded(df, digits=6, **columns):
    """Round the named columns, or all doubles, to ``digits``."""
    plan = columns or {c: digits for c, kind in df.dtypes if kind == "double"}
    return df.select(*[
        F.round(c, plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns
    ])


def terajoules(df, column, name):
    """Replace an energy in joules by terajoules with three decimals."""
    return df.withColumn(name, F.round(F.col(column) / 1e12, 3)).drop(column)


def as_text(df, *columns, pattern="yyyy-MM-dd HH:mm:ss"):
    for column in columns:
        df = df.withColumn(column, F.date_format(column, pattern))
    return df
