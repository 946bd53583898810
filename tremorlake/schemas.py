"""Explicit schemas for every zone. Nothing is inferred from data."""

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "doubles": T.ArrayType(T.DoubleType()),
}


def table(spec, **nested):
    """Schema from ``"name kind, ..."``; ``nested`` gives the types of other kinds."""
    kinds = {**_KINDS, **nested}
    pairs = (column.split() for column in spec.split(","))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


PROPERTIES = table(
    "mag double, place string, time bigint, updated bigint, felt int, cdi double, mmi double, "
    "alert string, status string, tsunami int, sig int, net string, nst int, dmin double, "
    "rms double, gap double, magType string, type string, title string"
)
GEOMETRY = table("type string, coordinates doubles")  # [longitude, latitude, depth_km]
METADATA = table("generated bigint, url string, title string, status int, count int")

CORRUPT = "_corrupt_record"

_FEATURE_SPEC = "id string, properties p, geometry g"
FEATURE = table(_FEATURE_SPEC, p=PROPERTIES, g=GEOMETRY)
FEATURE_LINES = table(f"{_FEATURE_SPEC}, {CORRUPT} string", p=PROPERTIES, g=GEOMETRY)


def feature_of(properties):
    """A feature with its id and the named properties only."""
    return table("id string, properties p", p=T.StructType([PROPERTIES[n] for n in properties]))


# One schema reads both a polled feed document and a landed batch document:
# a field the document does not carry is null.
COLLECTION = table(
    "type string, metadata m, ingested_at string, batch_count int, features f, "
    f"{CORRUPT} string",
    m=METADATA, f=T.ArrayType(FEATURE),
)
BUNDLE = table("batch_count int, features f", f=T.ArrayType(FEATURE))

# Features with untyped properties and geometry.
FEATURE_MAPS = table("id string, properties m, geometry m",
                     m=T.MapType(T.StringType(), T.StringType()))

LANDING_KEYS = ("YYYY", "MM", "DD", "HH")

QUAKES = table(
    "event_id string, magnitude double, place string, region string, event_time timestamp, "
    "epoch_millis bigint, longitude double, latitude double, depth_km double, felt_reports int, "
    "alert_level string, tsunami_flag int, significance int, magnitude_type string, "
    "seismic_energy_joules double, dt string"
)

CLEANSED = table(
    "event_id string, magnitude double, place string, epoch_millis bigint, longitude double, "
    "latitude double, depth_km double, felt_reports int, alert_level string, tsunami_flag int"
)

EVENT_FAMILY = table(
    "event_id string, mag double, place string, depth_km double, latitude double, "
    "longitude double, event_time string"
)
META_FAMILY = table("alert string, tsunami int, felt int, sig int, magType string")
SERVING_SPEC = "row_key string, region string, epoch_millis bigint, event e, meta m"
SERVING = table(SERVING_SPEC, e=EVENT_FAMILY, m=META_FAMILY)
SERVING_LOADS = table(f"{SERVING_SPEC}, load bigint", e=EVENT_FAMILY, m=META_FAMILY)


def activity_schema(unit):
    return table(
        f"{unit}_window timestamp, total_events bigint, avg_magnitude double, "
        "max_magnitude double, total_energy_joules double"
    )


REGIONAL = table(
    "region string, event_count bigint, avg_magnitude double, max_magnitude double, "
    "avg_depth_km double, tsunami_warnings bigint, total_felt_reports bigint, "
    "cumulative_energy_joules double"
)
DEPTH = table(
    "depth_category string, event_count bigint, avg_magnitude double, max_magnitude double"
)
DIURNAL = table(
    "day_idx int, day_of_week string, hour_of_day int, event_count bigint, "
    "avg_magnitude double, total_energy_joules double"
)
FREQUENCY = table("magnitude double, cumulative_count bigint, log10_count double")
PAGER = table(
    "alert_level string, tsunami_flag int, event_count bigint, avg_magnitude double, "
    "max_magnitude double, total_felt bigint"
)
