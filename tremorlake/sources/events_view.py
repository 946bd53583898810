"""The event stream table seen as earthquake features.

Gives the queries real input at every scale factor: each row of ``events`` becomes one raw
feature; magnitudes keep the exponential spread of the values.
"""

from pyspark.sql import types as T

from ..operators.cleansing import POINT, processed_columns
from ..schemas import PROPERTIES
from ..session import settle

# Place of user_id % 21; the last one is unknown.
PLACES = (
    "12 km SW of Petrolia, California",
    "10 km N of Test Bay, CA",
    "Southern Alaska",
    "Hawaii Region",
    "near the coast of Honshu, Japan",
    "Papua, Indonesia",
    "Off the coast of Bio-Bio, Chile",
    "Mindanao, Philippines",
    "Oaxaca, Mexico",
    "Kermadec Islands region",
    "Ponce, PR",
    "Malatya, Türkiye",
    "Tonga Islands Region",
    "Taiwan",
    "Iceland region",
    "Crete, Greece",
    "South Sandwich Islands region",
    "Haiti region",
    "Caracas, Venezuela",
    "Baja California, Mexico",
    None,
)
# Alert level by event type; any other type has none.
ALERTS = {"error": "red", "purchase": "green", "signup": "yellow", "view": "orange"}

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def events(spark, sf_dir):
    return settle(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def _sql(value):
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


_K = "CAST(get_json_object(props, '$.k') AS INT)"
_MAG10 = "(20 + floor(value / 8))"
_MILLIS = "unix_millis(CAST(ts AS TIMESTAMP))"
_ALERT = " ".join(f"WHEN '{kind}' THEN '{level}'" for kind, level in ALERTS.items())

# Numbers of eight digits at most are cut out of one of nine, which costs a third of the format.
_ID = """IF(event_id BETWEEN 0 AND 99999999, concat('q', substring(CAST(event_id + 100000000 AS STRING), 2)),
           format_string('q%08d', event_id))"""

# Flat raw columns: one per property or coordinate the table can give.
_RAW = {
    "id": _ID,
    "mag": f"{_MAG10} / 10D",
    "place": f"get(array({', '.join(map(_sql, PLACES))}), CAST(pmod(user_id, {len(PLACES)}) AS INT))",
    "time": _MILLIS,
    "updated": f"{_MILLIS} + {_K} * 1000",
    "felt": f"CASE WHEN event_type <> 'view' THEN {_K} END",
    "alert": f"CASE event_type {_ALERT} END",
    "tsunami": f"CASE WHEN {_K} % 17 = 0 THEN 1 ELSE 0 END",
    "sig": f"CAST({_MAG10} * 10 AS INT)",
    "magType": "CASE WHEN event_type <> 'click' THEN 'mww' END",
    "type": "'earthquake'",
    "longitude": "CAST(pmod(event_id * 37, 3600) AS DOUBLE) / 10 - 180",
    "latitude": "CAST(pmod(event_id * 53, 1400) AS DOUBLE) / 10 - 60",
    "depth_km": "CAST(pmod(event_id * 7919, 7000) AS DOUBLE) / 10",
}


# Whole thirty-day steps, by event id, that spread the one month of ``events`` over 2019 to 2025.
SPREAD_STEP = 30 * 86_400_000
SPREAD = f"(pmod(event_id * 37, 84) - 61) * {SPREAD_STEP}"


def _raw(spark, sf_dir, spread=False):
    columns = dict(_RAW, time=f"{_MILLIS} + {SPREAD}") if spread else _RAW
    return events(spark, sf_dir).selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def features(spark, sf_dir):
    """One raw feature per event, nested as in the feed; what the table lacks is null."""
    properties = ", ".join(
        (f.name if f.name in _RAW else f"CAST(NULL AS {f.dataType.simpleString()})") + f" AS {f.name}"
        for f in PROPERTIES
    )
    return _raw(spark, sf_dir).selectExpr(
        "id",
        f"struct({properties}) AS properties",
        f"struct('Point' AS type, array({', '.join(POINT)}) AS coordinates) AS geometry",
    )


def quakes(spark, sf_dir, spread=False):
    """The processed table over ``events``; its ids are unique, so no dedup is needed.

    Taken from the flat columns, so a query reads only the event columns it needs. ``spread``
    moves the events over seven years.
    """
    return _raw(spark, sf_dir, spread).selectExpr(*processed_columns("{}".format, POINT))
