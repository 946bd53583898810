"""Compaction of landed hours into columnar days, a few hours at a time.

A run folds the landed hours that no run before has folded; hours that are folded are never opened
again. Days are parts (see ``parts``) and only those that get or lose an event are replaced. Of the
copies of an event the one updated last stays, the earlier landed one among equals, wherever the
copies landed. An event whose time was revised may change its day: an index by id says on which
days an id was ever put.
"""

from pyspark.sql import functions as F

from ..operators.cleansing import dedup, drop_incomplete, processed_columns
from ..operators.seen import BROADCAST_IDS, bucketed, parts_of
from ..schemas import LANDING_KEYS, QUAKES, table
from . import parts
from .readers import read_landed

DAYS = type(QUAKES)(QUAKES.fields + table("updated bigint").fields)
PLACES = table("event_id string, dt string")
_HOUR = "-".join(f"{k}=(\\w+)" for k in LANDING_KEYS).replace("-", "/")


def landed_hours(spark, path):
    """Ingestion hours that have files, as "YYYY/MM/DD/HH": a listing, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.concat_ws("/", *[
        F.regexp_extract("path", _HOUR, k + 1) for k in range(len(LANDING_KEYS))])
    return sorted(r[0] for r in files.select(key.alias("hour")).distinct().collect()
                  if not r[0].startswith("/"))


def new_hours(spark, landed_path, path, until=None):
    """Landed hours that are not folded yet; those from ``until`` on are still open and stay."""
    folded = set(parts.manifest(spark, f"{path}/days").totals.get("hours", []))
    return [h for h in landed_hours(spark, landed_path)
            if h not in folded and (until is None or h < until)]


def landed_in(spark, landed_path, hours, form="lines"):
    """Features of those hours; only their folders are read."""
    return read_landed(spark, landed_path, form).filter(
        F.concat_ws("/", *LANDING_KEYS).isin(list(hours)))


def fold(spark, landed_path, path, form="lines", until=None):
    """Fold the new hours into the days below ``path`` and return them."""
    hours = new_hours(spark, landed_path, path, until)
    if not hours:
        return []
    known, index = (parts.manifest(spark, f"{path}/{t}") for t in ("days", "ids"))
    version = known.version + 1
    usable = drop_incomplete(landed_in(spark, landed_path, hours, form)).filter(
        F.col("properties.time").isNotNull())
    flat = dedup(usable).selectExpr(*processed_columns(), "properties.updated AS updated")
    new = parts.staged(bucketed(flat, column="event_id"), f"{path}/new")
    ids = new.select(parts.PART, "event_id")
    asked = F.broadcast(ids) if new.count() <= BROADCAST_IDS else ids
    places = parts.read(spark, f"{path}/ids", PLACES, index, parts_of(new))
    # Days of earlier copies: the index streams past the new ids.
    before = places.join(asked, [parts.PART, "event_id"], "left_semi").select("dt")
    days = sorted(r[0] for r in new.select("dt").union(before).distinct().collect())
    stored = parts.read(spark, f"{path}/days", DAYS, known, days)
    both = stored.drop(parts.PART).withColumn("old", F.lit(1)).unionByName(
        new.drop(parts.PART).withColumn("old", F.lit(0)))
    order = F.struct(F.coalesce("updated", F.lit(-2**63)), "old")
    row = F.struct(*[c for c in DAYS.fieldNames() if c != "event_id"])
    best = both.groupBy("event_id").agg(F.max_by(row, order).alias("kept")).select(
        "event_id", "kept.*")
    # The index only ever grows, so it may be ahead of the days, never behind.
    if index.version < version:
        grown = places.unionByName(new.select(*PLACES.fieldNames(), parts.PART)).distinct()
        parts.commit(grown, f"{path}/ids", index, version, parts_of(new))
    done = sorted({*known.totals.get("hours", []), *hours})
    parts.commit(best.select(*DAYS.fieldNames(), F.col("dt").alias(parts.PART)), f"{path}/days",
                 known, version, days, {"hours": done})
    return hours


def compacted(spark, path):
    """The days as the processed table."""
    days = f"{path}/days"
    return parts.read(spark, days, DAYS, parts.manifest(spark, days)).select(*QUAKES.fieldNames())
