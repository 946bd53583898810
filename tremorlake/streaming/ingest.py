"""Continuous ingest: landed feed documents to new features, activity, alerts, serving.

Each ``stream_*`` starts one query and returns it. All take ``checkpoint``, a folder on
shared storage: offsets, state and sink commits live there, so a query that lost executors
or its driver goes on where it was and writes each event once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import event_time
from ..functions.measures import seismic_energy
from ..operators.cleansing import dedup, drop_incomplete, flatten
from ..operators.filters import dispatch
from ..operators.serving import serving_rows, upsert_serving
from ..operators.statistics import HOURLY_SPIKE_SIGMAS
from ..schemas import (
    COLLECTION, CORRUPT, FEATURE, FEATURE_LINES, LANDING_KEYS, feature_of, table,
)
from ..sources import parts
from ..sources.writers import ingestion_instant, with_landing_keys

# The longest live feed repeats seven days; one more covers late files.
HORIZON = "8 days"

# Bounded and continuous runs.
AVAILABLE_NOW = {"availableNow": True}
EVERY_MINUTE = {"processingTime": "60 seconds"}


def _reader(spark, schema, max_files):
    reader = (
        spark.readStream.schema(schema)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", "true")
    )
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def stream_features(spark, path, max_files=None, form="documents", properties=None):
    """Features of landed documents (or lines) as they arrive.

    ``properties``: the only ones that are asked for. Spark prunes no nested columns of JSON, so
    a stream of documents that needs a few says so and the parser builds no others; the rows are
    the same.
    """
    if form == "lines":
        lines = _reader(spark, FEATURE_LINES, max_files).json(path).select(*FEATURE.fieldNames())
        return narrowed(lines, properties) if properties else lines
    schema = table("features f", f=T.ArrayType(feature_of(properties))) if properties else COLLECTION
    documents = _reader(spark, schema, max_files).option("multiLine", "true").json(path)
    return documents.select(F.explode("features").alias("feature")).select("feature.*")


def narrowed(features, properties):
    """Features with their id and the named properties only."""
    kept = F.struct(*[F.col(f"properties.{name}").alias(name) for name in properties])
    return features.select("id", F.when(F.col("properties").isNotNull(), kept).alias("properties"))


def _one_per_batch(features):
    """Keep one copy per id within each Arrow batch before the dedup shuffle.

    The state operator has no map-side combine of its own; without this an id that fills a
    third of the input would travel to one task copy by copy. Only the columns that ``features``
    has go to Python and through the shuffle, so a caller leaves out what it does not need.
    """
    def keep_first(batches):
        for batch in batches:
            codes = batch.column("id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.unique(codes, return_index=True)[1]
            yield batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))

    columns = features.select(*[c for c in FEATURE.fieldNames() if c in features.columns])
    return columns.mapInArrow(keep_first, columns.schema)


def stream_dedup(features, horizon=HORIZON):
    """New features only: an id seen within ``horizon`` of event time is dropped.

    State holds one key per id of the horizon, not of all time. Features that come later than
    that are dropped here and counted (``late`` in ``progress``); ``delivery.stream_delivery`` gives
    them a route of their own.
    """
    usable = drop_incomplete(features).filter(F.col("properties.time").isNotNull())
    timed = _one_per_batch(usable).withColumn("event_time", event_time("properties.time"))
    return timed.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["id"])


def _start(writer, checkpoint, trigger):
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger)


def stream_land(features, path, checkpoint, ingested_at=None, trigger=AVAILABLE_NOW,
                horizon=HORIZON):
    """New features into their ingestion hour, one line each; polled and landed are counted."""
    polled = features.observe("polled", F.count(F.lit(1)).alias("rows"))
    new = stream_dedup(polled, horizon).observe("landed", F.count(F.lit(1)).alias("rows"))
    rows = with_landing_keys(
        new.select(*FEATURE.fieldNames()), ingestion_instant(ingested_at)
    )
    writer = rows.writeStream.format("json").partitionBy(*LANDING_KEYS)
    return _start(writer, checkpoint, trigger).start(path)


SUMS = table(
    "hour_window timestamp, total_events bigint, magnitudes double, max_magnitude double, "
    "total_energy_joules double"
)


def _merged(rows):
    """Mergeable sums: adding the rows of a batch to those stored gives those of both."""
    return rows.groupBy(parts.PART, "hour_window").agg(
        F.sum("total_events").alias("total_events"), F.sum("magnitudes").alias("magnitudes"),
        F.max("max_magnitude").alias("max_magnitude"),
        F.sum("total_energy_joules").alias("total_energy_joules"))


def merge_activity(batch, path, number, slide=None):
    """Add a batch of new events to the activity table; its windows, and the new manifest.

    The table is one part per day: only the days that the batch touches are read and replaced. A
    batch that was merged before changes nothing. The manifest keeps, by day, the moments of the
    hourly counts, so a day that is revised brings its own along and takes the old ones back.
    """
    spark = batch.sparkSession
    known = parts.manifest(spark, path)
    if known.version >= number:
        return None, known
    span = F.window("event_time", "1 hour", slide) if slide else F.window("event_time", "1 hour")
    windows = batch.groupBy(span.alias("w")).agg(
        F.count(F.lit(1)).alias("total_events"), F.sum("magnitude").alias("magnitudes"),
        F.max("magnitude").alias("max_magnitude"),
        F.sum("seismic_energy_joules").alias("total_energy_joules"),
    ).select(F.col("w.start").alias("hour_window"), *[f.name for f in SUMS.fields[1:]],
             F.date_format("w.start", "yyyy-MM-dd").alias(parts.PART))
    windows = parts.staged(windows, path)
    touched = [r[0] for r in windows.select(parts.PART).distinct().collect()]
    stored = parts.read(spark, path, SUMS, known, touched)
    count = F.col("total_events").cast("decimal(38,0)")
    known = parts.commit(
        _merged(stored.unionByName(windows)), path, known, number, touched,
        stats={"hours": F.count(F.lit(1)), "sum": F.sum("total_events"),
               "squares": F.sum(count * count).cast("string")})
    return windows, known


ACTIVITY_PROPERTIES = ("mag", "time")  # what activity needs of a feature


def stream_activity(features, path, checkpoint, slide=None, trigger=AVAILABLE_NOW):
    """Hourly activity (or of sliding hours), kept up to date by each batch of new events.

    Read it with ``current_activity``.
    """
    new = _measured(stream_dedup(narrowed(features, ACTIVITY_PROPERTIES)))

    def merge(batch, number):
        merge_activity(batch, path, number, slide)

    return _start(new.writeStream.foreachBatch(merge), checkpoint, trigger).start()


def _measured(new):
    return new.select(
        "event_time", F.col("properties.mag").alias("magnitude"),
        seismic_energy("properties.mag").alias("seismic_energy_joules"))


def _windows(rows):
    return rows.select(
        "hour_window", "total_events",
        (F.col("magnitudes") / F.col("total_events")).alias("avg_magnitude"), "max_magnitude",
        "total_energy_joules")


def current_activity(spark, path):
    """Events, mean and peak magnitude and energy of each window."""
    return _windows(parts.read(spark, path, SUMS, parts.manifest(spark, path)))


def hourly_level(known, sigmas=HOURLY_SPIKE_SIGMAS):
    """Mean of the hourly counts, and mean + ``sigmas`` sample deviations (null below two hours),
    from the moments in the manifest: whole numbers, so nothing drifts."""
    n = sum(s["hours"] for s in known.stats.values())
    total = sum(s["sum"] for s in known.stats.values())
    squares = sum(int(s["squares"]) for s in known.stats.values())
    if not n:
        return None, None
    spread = ((n * squares - total * total) / (n * (n - 1))) ** 0.5 if n > 1 else None
    return total / n, None if spread is None else total / n + sigmas * spread


def _flagged(rows, known, sigmas):
    mean, limit = (F.lit(x).cast("double") for x in hourly_level(known, sigmas))
    return rows.select(
        "hour_window", "total_events", mean.alias("mean_events"), limit.alias("threshold")
    ).filter(F.col("total_events") > F.col("threshold"))


def current_spikes(spark, path, sigmas=HOURLY_SPIKE_SIGMAS):
    """Hours of the activity table that stand out now; the level comes from the manifest."""
    known = parts.manifest(spark, path)
    return _flagged(parts.read(spark, path, SUMS, known), known, sigmas)


ALERTED = table("hour_window timestamp, total_events bigint, mean_events double, threshold double, "
                "batch bigint")


def stream_spikes(features, activity_path, path, checkpoint, sigmas=HOURLY_SPIKE_SIGMAS,
                  trigger=AVAILABLE_NOW):
    """Alert on the hours of each batch that stand out from all hours so far.

    Only the days of the batch are read: what all other days add to the level is in the manifest.
    Alerts are facts of their batch, kept by day (``raised``).
    """
    def check(batch, number):
        spark = batch.sparkSession
        merge_activity(batch, activity_path, number)
        known, alerts = parts.manifest(spark, activity_path), parts.manifest(spark, path)
        if alerts.version >= number:
            return
        changed = spark.read.schema(windows_of).parquet(f"{activity_path}/stage")
        days = [r[0] for r in changed.select(parts.PART).distinct().collect()]
        rows = parts.read(spark, activity_path, SUMS, known, days).join(
            changed.select("hour_window"), "hour_window", "left_semi")
        flagged = _flagged(rows, known, sigmas).withColumn("batch", F.lit(number)).withColumn(
            parts.PART, F.date_format("hour_window", "yyyy-MM-dd"))
        before = parts.read(spark, path, ALERTED, alerts, days)
        parts.commit(before.unionByName(flagged), path, alerts, number, days)

    windows_of = table("hour_window timestamp, part string")
    return _start(_measured(stream_dedup(features)).writeStream.foreachBatch(check),
                  checkpoint, trigger).start()


def raised(spark, path):
    """Spike alerts with the number of the batch that raised them."""
    return parts.read(spark, path, ALERTED, parts.manifest(spark, path)).drop(parts.PART)


def stream_dispatch(features, path, checkpoint, trigger=AVAILABLE_NOW):
    """New events that need immediate notice, as they come."""
    flat = flatten(stream_dedup(features).drop("event_time"))
    writer = dispatch(flat).writeStream.format("parquet").outputMode("append")
    return _start(writer, checkpoint, trigger).start(path)


def stream_serving(features, path, checkpoint, trigger=AVAILABLE_NOW):
    """New events merged into the serving table, one load per batch; read it with
    ``serving.served``. A load replaces only the key ranges that it touches."""
    flat = flatten(stream_dedup(features).drop("event_time"))

    def load(batch, number):
        upsert_serving(serving_rows(batch), path, number)

    return _start(flat.writeStream.foreachBatch(load), checkpoint, trigger).start()


def run(query, timeout=None):
    """Wait for a bounded query, or ``timeout`` seconds of a continuous one, and stop it."""
    try:
        query.awaitTermination(timeout) if timeout else query.awaitTermination()
    finally:
        query.stop()
    return query


def late_features(features, landed):
    """Usable features of the feed, one per id, that a stream did not land (``landed`` has their
    ids): what came after the horizon. They are the input of ``dedup_incremental``."""
    return dedup(drop_incomplete(features)).join(landed.select("id"), "id", "left_anti")


PROGRESS = "batch bigint, polled bigint, landed bigint, late bigint"


def _progress_row(report):
    """Batch, rows polled and landed, rows dropped as late; None for a report without input."""
    observed = report.observedMetrics
    polled, landed = (observed[k]["rows"] if k in observed else 0 for k in ("polled", "landed"))
    late = sum(s.numRowsDroppedByWatermark for s in report.stateOperators)
    return (report.batchId, polled, landed, late) if report.numInputRows else None


def progress(spark, query):
    """Per micro-batch of the reports the session still keeps: rows polled, landed and late."""
    rows = [_progress_row(report) for report in query.recentProgress]
    return spark.createDataFrame([r for r in rows if r], PROGRESS)


def cycle_totals(rows):
    """Cycles that brought data, events polled and landed, and events dropped as late.

    ``rows``: of ``delivery.cycles`` for a whole run, of ``progress`` for its last reports.
    """
    return rows.agg(
        F.count_if(F.col("polled") > 0).alias("cycles"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("polled", "landed", "late")],
    )
