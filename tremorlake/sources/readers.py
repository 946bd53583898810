"""Readers of the raw, processed and rollup zones, and catalogue windows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import event_date, event_time, to_millis
from ..schemas import (
    COLLECTION, CORRUPT, FEATURE_LINES, FEATURE_MAPS, LANDING_KEYS, QUAKES,
)


def _json(reader, path, schema, glob):
    reader = (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    return reader.option("multiLine", str(schema is COLLECTION).lower()).json(path)


def explode_features(documents):
    """One row per feature of each document, with where it was found."""
    return documents.select(
        F.col("_metadata.file_path").alias("source_file"),
        "ingested_at",
        F.posexplode("features").alias("position", "feature"),
    ).select("feature.*", "source_file", "position", "ingested_at")


def read_feature_collections(spark, path, glob="*.json"):
    """Features of all feature-collection documents below ``path``."""
    return explode_features(_json(spark.read, path, COLLECTION, glob))


def broken_documents(spark, path, glob="*.json"):
    """Documents without a readable feature list, as text, for quarantine."""
    documents = _json(spark.read, path, COLLECTION, glob)
    return documents.filter(F.col("features").isNull()).select(
        F.col("_metadata.file_path").alias("source_file"), F.col(CORRUPT).alias("document")
    )


def read_features_ndjson(spark, path, glob="*.json*"):
    """Line-delimited features: the raw table. Broken lines carry ``_corrupt_record``."""
    lines = _json(spark.read, path, FEATURE_LINES, glob)
    return lines.withColumn("source_file", F.col("_metadata.file_path"))


def read_feature_maps(spark, path, glob="*.json*"):
    """Line-delimited features whose properties and geometry are string maps, for
    ``flatten_maps``."""
    return _json(spark.read, path, FEATURE_MAPS, glob)


def read_quakes(spark, path, fmt="parquet"):
    """The processed table with ``dt_utc``, the instant of ``epoch_millis``."""
    reader = spark.read.schema(QUAKES)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path).withColumn("dt_utc", event_time("epoch_millis"))


def read_rollup(spark, path, schema):
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_landed(spark, path, form="lines"):
    """Landed features with their ingestion-hour partition kept as text ("09", not 9)."""
    base = FEATURE_LINES if form == "lines" else COLLECTION
    schema = T.StructType(base.fields + [T.StructField(k, T.StringType()) for k in LANDING_KEYS])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    landed = reader.option("multiLine", str(form != "lines").lower()).json(path)
    if form == "lines":
        return landed
    return landed.select(
        F.explode("features").alias("feature"), "ingested_at", "batch_count", *LANDING_KEYS
    ).select("feature.*", "ingested_at", "batch_count", *LANDING_KEYS)


def landed_documents(spark, path):
    """``ingested_at`` and ``batch_count`` of each landed document."""
    schema = T.StructType([f for f in COLLECTION if f.name in ("ingested_at", "batch_count")])
    return spark.read.schema(schema).option("multiLine", "true").option(
        "recursiveFileLookup", "true").json(path)


# Fixed values: (start, end, least magnitude) of the two catalogue presets.
CATALOG_PRESETS = {
    "jul_oct_2024": ("2024-07-01", "2024-10-31", 3.0),
    "major_2020_2024": ("2020-01-01", "2024-12-31", 5.0),
}
# The live windows, in milliseconds.
LIVE_WINDOWS = {"hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def catalog_window(quakes, start=None, end=None, min_magnitude=None):
    """Events between two instants, both included.

    The bounds are literals, so they reach the file scan; where the table carries its
    ``dt`` partition they are repeated on it and whole days are never opened.
    """
    kept = quakes
    for instant, later in ((start, True), (end, False)):
        if instant is None:
            continue
        millis = to_millis(instant)
        limit, day = F.lit(millis), event_date(F.lit(millis))
        kept = kept.filter(
            F.col("epoch_millis") >= limit if later else F.col("epoch_millis") <= limit
        )
        if "dt" in quakes.columns:
            kept = kept.filter(F.col("dt") >= day if later else F.col("dt") <= day)
    if min_magnitude is not None:
        kept = kept.filter(F.col("magnitude") >= F.lit(float(min_magnitude)))
    return kept


def catalog_preset(quakes, name):
    start, end, least = CATALOG_PRESETS[name]
    return catalog_window(quakes, start, end, least)


def past(quakes, as_of, window):
    """Events of the last hour, day or week before ``as_of`` (which is included)."""
    end = to_millis(as_of)
    return catalog_window(quakes, end - LIVE_WINDOWS[window], end)
