"""A feed delivered in one pass: new events land, late ones leave by their own route, both raise
their alerts, and every cycle is in a ledger.

The ids of the horizon are a table of hash buckets (``operators.seen``), which a micro-batch reads
and replaces only where it brings ids. Nothing is dropped for being late: an event that is older
than the horizon behind the newest event of all batches before, and was not seen, is landed on the
route ``late``. What a batch does is a function of the batch and of the last commit, and each of its
outputs replaces what the same batch wrote before; the commit of the seen ids is the last step. So a
run that was killed anywhere does its open batch again and ends with each event once and with
totals that are exact.
"""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.clock import DAY_MS
from ..operators import seen
from ..operators.cleansing import dedup, drop_incomplete, processed_columns
from ..operators.filters import dispatch
from ..schemas import FEATURE, FEATURE_LINES, LANDING_KEYS, QUAKES, table
from ..sources import parts
from ..sources.writers import ingestion_instant, with_landing_keys
from .ingest import AVAILABLE_NOW, _start

HORIZON_DAYS = 8
ROUTE, LANDED, LATE = "route", "landed", "late"
CYCLE = table("batch bigint, polled bigint, landed bigint, late bigint")


def deliver(batch, number, path, store, alerts=None, ledger=None, ingested_at=None,
            horizon_days=HORIZON_DAYS):
    """Deliver one micro-batch of polled features; nothing is done twice.

    ``path``: landed lines by batch, route and ingestion hour. ``store``: ids seen. ``alerts``: events
    that need notice, by batch. ``ledger``: a row per batch with what was polled, landed and late.
    """
    spark = batch.sparkSession
    known = parts.manifest(spark, store)
    if known.version >= number:
        return known
    entered = parts.manifest(spark, ledger) if ledger else None
    instant = F.lit(spark.range(1).select(ingestion_instant(ingested_at)).first()[0])
    polled = Observation()
    usable = drop_incomplete(batch.observe(polled, F.count(F.lit(1)).alias("rows"))).filter(
        F.col("properties.time").isNotNull())
    # Copies of one id meet in the map-side combine; the batch is read and parsed once.
    one = parts.staged(seen.bucketed(dedup(usable)), f"{store}/polled")
    new = parts.staged(seen.unseen(one, store, known), f"{store}/new")
    time, newest = F.col("properties.time"), known.totals.get("newest")
    is_late = F.lit(False) if newest is None else time < newest - horizon_days * DAY_MS
    routed = new.withColumn(ROUTE, F.when(is_late, LATE).otherwise(LANDED))
    with_landing_keys(routed.select(*FEATURE.fieldNames(), ROUTE), instant) \
        .write.mode("overwrite").partitionBy(ROUTE, *LANDING_KEYS).json(f"{path}/batch={number}")
    if alerts:
        flat = routed.selectExpr(*processed_columns(), f"{ROUTE} = '{LATE}' AS late")
        dispatch(flat).write.mode("overwrite").parquet(f"{alerts}/batch={number}")
    found = routed.agg(
        F.count_if(F.col(ROUTE) == LANDED).alias("landed"),
        F.count_if(F.col(ROUTE) == LATE).alias("late")).first()
    latest = one.agg(F.max(time)).first()[0]
    if ledger:
        _enter(spark, ledger, entered, (number, polled.get["rows"], found.landed, found.late))
    totals = {name: known.totals.get(name, 0) + add for name, add in (
        ("cycles", int(polled.get["rows"] > 0)), ("polled", polled.get["rows"]),
        ("landed", found.landed), ("late", found.late))}
    totals["newest"] = max((t for t in (newest, latest) if t is not None), default=None)
    return seen.add(new, store, known, number, instant, horizon_days, totals)


def _enter(spark, ledger, known, row):
    """The batch's row, in a part of a thousand batches that is replaced whole."""
    number = row[0]
    if known.version >= number:
        return
    part = f"{number // 1000:09d}"
    rows = spark.createDataFrame([row], CYCLE).withColumn(parts.PART, F.lit(part))
    before = parts.read(spark, ledger, CYCLE, known, [part])
    parts.commit(before.unionByName(rows), ledger, known, number, [part])


def stream_delivery(features, path, store, checkpoint, alerts=None, ledger=None, ingested_at=None,
                    trigger=AVAILABLE_NOW, horizon_days=HORIZON_DAYS):
    """Deliver a feed as it arrives, see ``deliver``."""
    def sink(batch, number):
        deliver(batch, number, path, store, alerts, ledger, ingested_at, horizon_days)

    return _start(features.writeStream.foreachBatch(sink), checkpoint, trigger).start()


def delivered(spark, path, route=None):
    """Landed lines of a route (both if none is named), with batch, route and ingestion hour."""
    keys = table(", ".join(f"{k} string" for k in (ROUTE, *LANDING_KEYS)) + ", batch bigint")
    rows = spark.read.schema(type(keys)(FEATURE_LINES.fields + keys.fields)).json(path)
    return rows.filter(F.col(ROUTE) == route) if route else rows


def delivered_alerts(spark, path):
    """Alerts with the batch that raised them and whether the event came late."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUAKES)
    return spark.read.schema(f"{columns}, late boolean, batch bigint").parquet(path)


def cycles(spark, ledger):
    """One row per batch of the ledger."""
    return parts.read(spark, ledger, CYCLE, parts.manifest(spark, ledger)).drop(parts.PART)


def totals(spark, store):
    """Cycles, events polled, landed and late of all batches, as last committed: one row."""
    found = parts.manifest(spark, store).totals
    row = tuple(found.get(n, 0) for n in ("cycles", "polled", "landed", "late"))
    return spark.createDataFrame(
        [row], table("cycles bigint, polled bigint, landed bigint, late bigint"))
