"""Ids seen within a horizon: a table of hash buckets that polls extend.

A poll reads only the buckets its ids fall in, and those are streamed past the poll's own ids: the
stored side is neither shuffled nor sorted. Only buckets that get new ids are written again, without
the ids that left the horizon.
"""

from pyspark.sql import functions as F

from ..schemas import table
from ..sources import parts

SEEN = table("id string, last_seen timestamp")
BUCKETS = 16  # of a store: more for longer horizons; it stays as it was made
BROADCAST_IDS = 1_000_000  # ids of a poll that are sent to the scan of the store; more are joined


def bucketed(rows, buckets=BUCKETS, column="id"):
    """Rows with the bucket of their id as ``part``."""
    return rows.withColumn(parts.PART, F.format_string(
        "b%05d", F.pmod(F.xxhash64(column), F.lit(buckets))))


def parts_of(rows):
    """The parts that ``rows`` touch."""
    return sorted(r[0] for r in rows.select(parts.PART).distinct().collect())


def known_ids(rows, store, known):
    """Ids of ``rows`` (a written table with ``part``, one row per id) that the store has."""
    spark = rows.sparkSession
    ids = rows.select(parts.PART, "id")
    # A poll of bounded, counted size goes to where the store is read.
    asked = F.broadcast(ids) if rows.count() <= BROADCAST_IDS else ids
    stored = parts.read(spark, store, SEEN, known, parts_of(rows))
    return stored.select(parts.PART, "id").join(asked, [parts.PART, "id"], "left_semi")


def unseen(rows, store, known):
    """``rows`` whose id the store does not have."""
    return rows.join(known_ids(rows, store, known), [parts.PART, "id"], "left_anti")


def add(new, store, known, version, instant, horizon_days=None, totals=None):
    """Commit the ids of ``new`` (written, with ``part``) as seen at ``instant``."""
    spark = new.sparkSession
    touched = parts_of(new)
    before = parts.read(spark, store, SEEN, known, touched)
    if horizon_days is not None:
        before = before.filter(
            F.col("last_seen") >= instant - F.make_dt_interval(F.lit(horizon_days)))
    fresh = new.select("id", instant.cast("timestamp").alias("last_seen"), parts.PART)
    return parts.commit(before.unionByName(fresh), store, known, version, touched, totals)


def poll(features, store, version, batch_time):
    """One poll of a feed: (features not seen before, audit row); the store has their ids then.

    ``batch_time`` is a column. A poll that was committed before adds nothing and finds nothing new.
    """
    from .cleansing import dedup

    spark = features.sparkSession
    known = parts.manifest(spark, store)
    polled = features.agg(F.count(F.lit(1))).first()[0]
    one = parts.staged(bucketed(dedup(features)), f"{store}/polled")
    new = parts.staged(unseen(one, store, known), f"{store}/new")
    if known.version < version:
        known = add(new, store, known, version, batch_time)
    seen = sum(s["rows"] for s in known.stats.values())
    audit = spark.createDataFrame(
        [(polled, new.count(), seen)], table("polled bigint, new bigint, seen bigint"))
    return new.drop(parts.PART), audit


def seen_ids(spark, store):
    """All ids of the store with the instant they were seen."""
    return parts.read(spark, store, SEEN, parts.manifest(spark, store)).drop(parts.PART)
