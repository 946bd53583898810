"""The serving table: newest-first keys per region, two column families."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.clock import DAY_MS, to_millis
from ..functions.keys import key_range, row_key
from ..schemas import SERVING, SERVING_LOADS
from ..sources import parts

RETENTION_DAYS = 30  # fixed value: the event family's lifetime
LATEST = 10  # fixed value
LOAD = "load"  # partition column: number of the load that wrote a row

POINT_COLUMNS = ("event_id", "magnitude", "place", "depth_km", "event_time", "alert_level")


def serving_rows(quakes):
    return quakes.select(
        row_key("region", "epoch_millis").alias("row_key"),
        "region",
        "epoch_millis",
        F.struct(
            "event_id",
            F.col("magnitude").alias("mag"),
            "place",
            "depth_km",
            "latitude",
            "longitude",
            F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("event_time"),
        ).alias("event"),
        F.struct(
            F.col("alert_level").alias("alert"),
            F.col("tsunami_flag").alias("tsunami"),
            F.col("felt_reports").alias("felt"),
            F.col("significance").alias("sig"),
            F.col("magnitude_type").alias("magType"),
        ).alias("meta"),
    )


def last_write_wins(rows, load=LOAD):
    """One row per key, of the latest load; within a load the largest event id.

    An aggregate with map-side combine, so a key written over and over stays cheap.
    """
    newest = F.struct(F.col(load), F.col("event.event_id"))
    payload = F.struct("region", "epoch_millis", "event", "meta")
    return (
        rows.select("row_key", payload.alias("kept"), newest.alias("ord"))
        .groupBy("row_key").agg(F.max_by("kept", "ord").alias("kept"))
        .select("row_key", "kept.*")
    )


def upsert(old, new):
    """Rows of both; for a key in both the new row."""
    rows = old.withColumn(LOAD, F.lit(0)).unionByName(new.withColumn(LOAD, F.lit(1)))
    return last_write_wins(rows)


def load_audit(rows):
    """Rows written, distinct keys, and rows that overwrote another."""
    per_key = rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("loaded"),
        F.count(F.lit(1)).alias("row_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("collisions"),
    )


def write_serving(rows, path):
    """Write in key order below region folders.

    A load upserts: of rows with one key the largest event id stays. Ranges are cut on (region,
    key), so a large region spans many tasks and files with disjoint key ranges; a seek opens
    only the file whose key statistics fit.
    """
    (
        last_write_wins(rows if LOAD in rows.columns else rows.withColumn(LOAD, F.lit(0)))
        .repartitionByRange("region", "row_key")
        .sortWithinPartitions("region", "row_key")
        .write.mode("overwrite").partitionBy("region").parquet(path)
    )


def append_load(rows, path, load):
    """Add one load in its own partition; writing it again replaces it.

    Rebalanced rather than range-partitioned: that needs no sampling pass, so a stream's
    batch is evaluated once.
    """
    (
        last_write_wins(rows.withColumn(LOAD, F.lit(load)))
        .withColumn(LOAD, F.lit(load))
        .hint("rebalance", F.col("region"))
        .sortWithinPartitions("region", "row_key")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(LOAD, "region").parquet(path)
    )


PART_ROWS = 1_000_000  # of a key range, about; one that grows to twice that is cut


def _fence_of(key, fences):
    """Name of the key range that ``key`` falls in: the last that begins at or before it, or the
    first. ``fences``: (least key, name) in order, at least one."""
    at = F.size(F.filter(F.array(*[F.lit(low) for low, _ in fences[1:]]), lambda low: low <= key)) \
        if len(fences) > 1 else F.lit(0)
    return F.get(F.array(*[F.lit(name) for _, name in fences]), at)


def upsert_serving(rows, path, version, part_rows=PART_ROWS):
    """Merge a load into the serving table on storage and return the key ranges it replaced.

    The table is parts of disjoint key ranges whose least and greatest keys are in the manifest.
    A load is dealt to ranges by those fences, and only ranges that get a row are read and written
    again: ten keys replace ten ranges at most, however large the table. A row replaces the row of
    its key, among the load's own the largest event id. A range that has outgrown its size is cut.
    A load that was merged before changes nothing.
    """
    spark = rows.sparkSession
    known = parts.manifest(spark, path)
    if known.version >= version:
        return []
    fences = sorted((s["low"], p) for p, s in known.stats.items())
    dealt = last_write_wins(rows.withColumn(LOAD, F.lit(0)))
    dealt = dealt.withColumn(parts.PART, _fence_of(F.col("row_key"), fences) if fences
                             else F.lit("k"))
    dealt = parts.staged(dealt, f"{path}/load")
    touched = sorted(r[0] for r in dealt.select(parts.PART).distinct().collect())
    old = parts.read(spark, path, SERVING, known, touched)
    both = old.withColumn(LOAD, F.lit(0)).unionByName(dealt.withColumn(LOAD, F.lit(1)))
    newest = F.struct(LOAD, "event.event_id")
    payload = F.struct("region", "epoch_millis", "event", "meta")
    merged = parts.staged(
        both.groupBy(parts.PART, "row_key").agg(F.max_by(payload, newest).alias("kept"))
        .select("row_key", "kept.*", parts.PART), f"{path}/merged")
    sizes = {r[0]: r[1] for r in merged.groupBy(parts.PART).count().collect()}
    large = [p for p, n in sizes.items() if n > 2 * part_rows]
    if large:
        cuts = -(-sum(sizes[p] for p in large) // part_rows)
        piece = F.concat(parts.PART, F.format_string(f"~{version}-%d", F.spark_partition_id()))
        cut = merged.filter(F.col(parts.PART).isin(large)).repartitionByRange(
            cuts, parts.PART, "row_key").withColumn(parts.PART, piece)
        merged = parts.staged(
            merged.filter(~F.col(parts.PART).isin(large)).unionByName(cut), f"{path}/cut")
        pieces = [r[0] for r in merged.select(parts.PART).distinct().collect()]
        touched = sorted({*touched, *pieces})
    parts.commit(merged.sortWithinPartitions("row_key"), path, known, version, touched,
                 stats={"low": F.min("row_key"), "high": F.max("row_key")})
    return touched


def served(spark, path, region=None):
    """The serving table of ``upsert_serving``; of one region only the key ranges that can hold it
    are opened."""
    known = parts.manifest(spark, path)
    if region is None:
        return parts.read(spark, path, SERVING, known).drop(parts.PART)
    first, stop = key_range(region)
    own = [p for p, s in known.stats.items() if s["low"] < stop and s["high"] >= first]
    return in_key_range(parts.read(spark, path, SERVING, known, own).drop(parts.PART), region)


def read_serving(spark, path):
    return spark.read.schema(SERVING).parquet(path)


def read_loads(spark, path):
    """All loads as written; resolve them with ``last_write_wins`` after filtering."""
    return spark.read.schema(SERVING_LOADS).parquet(path)


def compact_loads(spark, path, target):
    """Resolve all loads into one serving table; seeks then need no aggregate."""
    write_serving(read_loads(spark, path), target)


def in_key_range(serving, region):
    """Rows of one region: its folder, and its key range pushed to the files."""
    first, stop = key_range(region)
    return serving.filter(
        (F.col("region") == region) & (F.col("row_key") >= first) & (F.col("row_key") < stop)
    )


def seek(serving, region, n=LATEST, columns=None, min_magnitude=None):
    """The newest ``n`` rows of a region in key order."""
    rows = in_key_range(serving, region)
    if min_magnitude is not None:
        rows = rows.filter(F.col("event.mag") >= F.lit(float(min_magnitude)))
    rows = rows.orderBy("row_key").limit(n)
    return rows.select(*columns) if columns else rows


def seek_loads(loads, region, n=LATEST, columns=None, min_magnitude=None):
    """A seek on a table of loads: the key range is cut first, then its last writes taken."""
    resolved = last_write_wins(in_key_range(loads, region))
    return seek(resolved, region, n, columns, min_magnitude)


def seek_table(serving, region, n=5):
    """The console listing of a seek."""
    return seek(serving, region, n, [
        "row_key",
        F.concat(F.lit("M "), F.format_number("event.mag", 1)).alias("magnitude"),
        F.col("event.place").alias("place"),
        F.col("event.depth_km").alias("depth_km"),
        F.col("event.event_time").alias("event_time"),
        F.col("meta.alert").alias("alert"),
    ])


def seek_one(serving, region, min_magnitude=None):
    """Four columns of the newest row of a region; only those are read."""
    return seek(serving, region, 1, [
        F.col("event.mag").alias("mag"),
        F.col("event.place").alias("place"),
        F.col("event.event_time").alias("event_time"),
        F.col("meta.alert").alias("alert"),
    ], min_magnitude)


def latest(quakes, region, n=LATEST):
    """The newest ``n`` events of a region from the processed table."""
    return (
        quakes.filter(F.col("region") == region)
        .orderBy(F.desc("epoch_millis"), "event_id").limit(n)
        .select(*POINT_COLUMNS)
    )


def latest_all(serving, n=LATEST):
    """The newest ``n`` rows of every region; each map task passes on at most ``n`` of one."""
    newest_first = W.partitionBy("region").orderBy("row_key", "event.event_id")
    return (
        serving.withColumn("rank", F.row_number().over(newest_first))
        .filter(F.col("rank") <= n)
    )


def expire_event_family(serving, as_of, days=RETENTION_DAYS):
    """Empty the event family of rows older than ``days``; the meta family stays."""
    oldest = F.lit(to_millis(as_of) - days * DAY_MS)
    return serving.withColumn("event", F.when(F.col("epoch_millis") >= oldest, F.col("event")))
