"""Streams over a feed that is landed delivery by delivery, and what they left behind.

A query's stream runs to the end of its input after each of four deliveries, so it has at least four
micro-batches. Every delivery brings the events of eight days and, updated later, those of the eight
days before again, as a sliding feed does. A path that is given instead holds the whole feed at once.
"""

from pyspark.sql import functions as F

from .. import schemas
from ..operators import serving
from ..session import workspace
from ..sources import readers, writers
from ..sources.events_view import features
from ..streaming import delivery, ingest
from .cleansing import set_property
from .registry import as_text, oracle, query, rounded, terajoules

LANDED_AT = "2024-02-01 05:06:07"


def prepare(spark, sf_dir, form="documents"):
    """Land the feed and return its path: the prepared input that the streams take."""
    path = workspace(spark, "feed")
    for delivery in (LANDED_AT, "2024-02-01 06:00:00"):
        writers.land_features(features(spark, sf_dir), path, delivery, form)
    return path


WEEKS = 4  # of eight days


def _week():
    return F.floor((F.dayofmonth(F.timestamp_millis("properties.time")) - 1) / 8)


def _in_polls(spark, sf_dir, start, path=None, properties=None):
    """Run the stream that ``start`` makes of the feed after each delivery, in time order.

    ``properties``: what the stream needs of them, see ``ingest.stream_features``."""
    def run():
        ingest.run(start(ingest.stream_features(spark, path, properties=properties)))

    if path:
        run()
        return
    path, rows = workspace(spark, "feed"), features(spark, sf_dir)
    for k in range(WEEKS):
        # One scan brings both weeks.
        later = F.when(_week() == k, 0).otherwise(3_600_000)
        both = set_property(rows.filter(_week().isin(k - 1, k)),
                            updated=F.col("properties.updated") + later)
        writers.land_features(both, path, f"2024-02-01 0{k}:00:00")
        run()


def _folders(spark, name):
    return workspace(spark, name), workspace(spark, f"{name}-checkpoint")


def _to_parquet(rows, out, checkpoint):
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
        **ingest.AVAILABLE_NOW).start(out)


@query("g1_stream_features", oracle("""
SELECT id, mag, time, CASE WHEN (day(make_timestamp(time * 1000)) - 1) // 8 < 3 THEN 2 ELSE 1 END::BIGINT AS deliveries
FROM raw"""))
def polled(spark, sf_dir):
    out, checkpoint = _folders(spark, "g1")
    _in_polls(spark, sf_dir, lambda feed: _to_parquet(feed, out, checkpoint))
    rows = spark.read.schema(schemas.FEATURE).parquet(out)
    return rows.groupBy(
        "id", F.col("properties.mag").alias("mag"), F.col("properties.time").alias("time")
    ).agg(F.count(F.lit(1)).alias("deliveries"))


@query("g2_stream_dedup", oracle("SELECT id, mag, time, updated FROM raw"))
def dedup(spark, sf_dir):
    """The first copy of each event stays: ``updated`` is that of its first delivery."""
    out, checkpoint = _folders(spark, "g2")
    _in_polls(spark, sf_dir, lambda feed: _to_parquet(
        ingest.stream_dedup(feed).drop("event_time"), out, checkpoint))
    return spark.read.schema(schemas.FEATURE).parquet(out).select("id", *[
        F.col(f"properties.{c}").alias(c) for c in ("mag", "time", "updated")])


@query("g3_stream_land", oracle("""
SELECT id, mag, place, time, '2024' AS "YYYY", '02' AS "MM", '01' AS "DD", '07' AS "HH" FROM raw"""))
def land(spark, sf_dir, path=None):
    out, checkpoint = _folders(spark, "g3")
    _in_polls(spark, sf_dir, lambda feed: ingest.stream_land(
        feed, out, checkpoint, "2024-02-01 07:00:00"), path)
    return readers.read_landed(spark, out).select(
        "id", F.col("properties.mag").alias("mag"), F.col("properties.place").alias("place"),
        F.col("properties.time").alias("time"), *schemas.LANDING_KEYS,
    )


@query("g8_bounded_then_continuous", oracle(
    "SELECT count(*) AS landed, count(DISTINCT id) AS ids FROM raw"))
def triggers(spark, sf_dir):
    """A bounded run over the first delivery, then a continuous one on the same checkpoint, which
    finds the second delivery and lands nothing twice."""
    path, out, checkpoint = workspace(spark, "g8-feed"), *_folders(spark, "g8")
    rows = features(spark, sf_dir)
    early = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    writers.land_features(rows.filter(early), path, LANDED_AT, "lines")
    stream = ingest.stream_features(spark, path, form="lines")
    # A horizon that holds the whole month: nothing is late.
    ingest.run(ingest.stream_land(stream, out, checkpoint, horizon="60 days"))
    writers.land_features(rows, path, "2024-02-01 06:00:00", "lines")
    following = ingest.stream_land(
        stream, out, checkpoint, trigger={"processingTime": "1 second"}, horizon="60 days")
    try:
        following.processAllAvailable()
    finally:
        following.stop()
    return readers.read_landed(spark, out).agg(
        F.count(F.lit(1)).alias("landed"), F.countDistinct("id").alias("ids")
    )


def _in_weeks(spark, sf_dir, path, poll=None):
    """Deliveries, newest week first: ``poll`` runs after each; without it each is one file."""
    rows = features(spark, sf_dir)
    for k in reversed(range(WEEKS)):
        part = rows.filter(_week() == k)
        writers.land_features(part if poll else part.coalesce(1), path,
                              f"2024-02-01 0{9 - k}:00:00", "lines")
        if poll:
            poll()


class _Delivered:
    """The feed delivered newest week first, one pass a delivery."""

    def __init__(self, spark, sf_dir, name):
        self.feed, self.out, self.store, self.alerts, self.ledger, self.checkpoint = (
            workspace(spark, f"{name}-{x}")
            for x in ("feed", "out", "store", "alerts", "ledger", "checkpoint"))

        def poll():
            stream = ingest.stream_features(spark, self.feed, form="lines")
            ingest.run(delivery.stream_delivery(
                stream, self.out, self.store, self.checkpoint, self.alerts, self.ledger,
                "2024-02-01 10:00:00"))

        self.poll = poll
        _in_weeks(spark, sf_dir, self.feed, poll)


# Behind the newest event of the deliveries before, by more than the horizon.
_LATE = """delivered AS (
  SELECT *, (day(make_timestamp(time * 1000)) - 1) // 8 AS week FROM raw),
newest AS (
  SELECT a.week, max(b.time) AS newest
  FROM (SELECT DISTINCT week FROM delivered) a LEFT JOIN delivered b ON b.week > a.week GROUP BY a.week),
routed AS (
  SELECT delivered.*, coalesce(time < newest - 8 * 86400000, false) AS late
  FROM delivered JOIN newest USING (week))"""


@query("g2_stream_late", oracle(
    "SELECT id, CASE WHEN late THEN 'late' ELSE 'landed' END AS route, mag, time FROM routed", _LATE))
def late(spark, sf_dir):
    """Polls out of time order over four weeks: every event is delivered once, what is older than
    the horizon by its own route."""
    done = _Delivered(spark, sf_dir, "late")
    return delivery.delivered(spark, done.out).select(
        "id", "route", F.col("properties.mag").alias("mag"), F.col("properties.time").alias("time"))


@query("g6_late_dispatch", oracle("""
SELECT quakes.event_id, quakes.alert_level, quakes.tsunami_flag, late
FROM quakes JOIN routed ON routed.id = quakes.event_id
WHERE quakes.tsunami_flag = 1 OR quakes.alert_level IN ('yellow', 'orange', 'red')""", _LATE))
def late_dispatch(spark, sf_dir):
    """An event that comes late raises its alert in the same pass."""
    done = _Delivered(spark, sf_dir, "late-alerts")
    return delivery.delivered_alerts(spark, done.alerts).select(
        "event_id", "alert_level", "tsunami_flag", "late")


@query("g9_cycle_totals", oracle("""
SELECT 5::BIGINT AS cycles, 2 * count(*) AS polled, count(*) FILTER (NOT late) AS landed,
       count(*) FILTER (late) AS late, 5::BIGINT AS entered, 2 * count(*) AS entered_polled
FROM routed""", _LATE))
def totals(spark, sf_dir):
    """Four deliveries and one that brings everything again: totals of the last commit, and of the
    ledger's rows."""
    done = _Delivered(spark, sf_dir, "g9")
    writers.land_features(features(spark, sf_dir), done.feed, "2024-02-01 11:00:00", "lines")
    done.poll()
    entered = delivery.cycles(spark, done.ledger).agg(
        F.count(F.lit(1)).alias("entered"), F.sum("polled").alias("entered_polled"))
    return delivery.totals(spark, done.store).select(
        "*", *[entered.select(c).scalar().alias(c) for c in entered.columns])


@query("g4_stream_activity", oracle("""
SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS hour_window,
       count(*) AS total_events, round(avg(magnitude), 9) AS avg_magnitude,
       max(magnitude) AS max_magnitude, round(sum(energy) / 1e12, 3) AS total_energy_tj
FROM quakes GROUP BY 1"""))
def activity(spark, sf_dir, path=None):
    out, checkpoint = _folders(spark, "g4")
    _in_polls(spark, sf_dir, lambda feed: ingest.stream_activity(feed, out, checkpoint), path,
              ingest.ACTIVITY_PROPERTIES)
    rows = terajoules(ingest.current_activity(spark, out), "total_energy_joules", "total_energy_tj")
    return as_text(rounded(rows, avg_magnitude=9), "hour_window")


@query("g4_stream_activity_sliding", oracle("""
SELECT strftime(to_timestamp((epoch_millis // 900000 - back) * 900) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS hour_window,
       count(*) AS total_events, max(magnitude) AS max_magnitude
FROM quakes, range(4) r(back) GROUP BY 1"""))
def sliding(spark, sf_dir):
    out, checkpoint = _folders(spark, "g4-sliding")
    _in_polls(spark, sf_dir, lambda feed: ingest.stream_activity(
        feed, out, checkpoint, "15 minutes"))
    rows = ingest.current_activity(spark, out)
    return as_text(rows.select("hour_window", "total_events", "max_magnitude"), "hour_window")


@query("g5_stream_spikes", oracle("""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS hour_window, n AS total_events, round(m, 6) AS mean_events,
       round(m + 2.0::DOUBLE * s, 6) AS threshold
FROM counted, (SELECT avg(n) AS m, stddev_samp(n) AS s FROM counted) WHERE n > m + 2.0::DOUBLE * s""",
    "counted AS (SELECT date_trunc('hour', event_time) AS w, count(*) AS n FROM quakes GROUP BY 1)"))
def spikes(spark, sf_dir):
    (out, checkpoint), hours = _folders(spark, "g5"), workspace(spark, "g5-hours")
    _in_polls(spark, sf_dir, lambda feed: ingest.stream_spikes(feed, hours, out, checkpoint))
    return as_text(rounded(ingest.current_spikes(spark, hours)), "hour_window")


@query("g6_stream_dispatch", oracle(
    "SELECT event_id, alert_level, tsunami_flag FROM quakes "
    "WHERE tsunami_flag = 1 OR alert_level IN ('yellow', 'orange', 'red')"))
def dispatch(spark, sf_dir):
    out, checkpoint = _folders(spark, "g6")
    _in_polls(spark, sf_dir, lambda feed: ingest.stream_dispatch(feed, out, checkpoint))
    return spark.read.schema(schemas.QUAKES).parquet(out).select(
        "event_id", "alert_level", "tsunami_flag"
    )


@query("g7_stream_serving", oracle("""
SELECT region || '#' || lpad(CAST(9223372036854775807 - epoch_millis AS VARCHAR), 19, '0') AS row_key,
       region, epoch_millis, max(event_id) AS event_id FROM quakes GROUP BY 1, 2, 3"""))
def serve(spark, sf_dir):
    out, checkpoint = _folders(spark, "g7")
    _in_polls(spark, sf_dir, lambda feed: ingest.stream_serving(feed, out, checkpoint))
    return serving.served(spark, out).select(
        "row_key", "region", "epoch_millis", F.col("event.event_id").alias("event_id")
    )
