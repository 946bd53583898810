"""Sharding (8): global byte-size prefix sums cut at equal targets.

Rows are ranged by doc_id; each range's totals are summed over ranges (one small row per range), and
a row's place is its range's start plus the running sum inside the range. The cuts lie at equal
steps of the byte total, so shards are contiguous in doc_id order and differ by about one document.

Null text: size 1, CRC of nothing. Null doc_ids come first; rows of one doc_id go by size, CRC and
input order, and may lie in two shards. An empty table gives no rows. Extra columns are not read by
``assign`` and stay as they are in ``write_shards``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import fresh, stored, table, unsigned

SHARDS = 8
_BEFORE = (Window.unboundedPreceding, -1)
_EVERY = (Window.unboundedPreceding, Window.unboundedFollowing)


def _sized(docs, row=None):
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"),
        unsigned(F.col("text")).cast("bigint").alias("text_crc32"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))


def assign(docs, shards=SHARDS, row=None):
    """doc_id, size, text_crc32, shard, slot; and ``row``, the number of the input row (that of the
    column ``row`` where one is named)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "size", "text_crc32", "row"]
    # Texts stay where they are: only these four numbers are moved.
    ranged = _sized(docs, row).repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "sizes")
    own = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per range, and at most ``shards`` cuts: bounded by the number of partitions.
    every = Window.orderBy("part")
    parts = own.select(
        "part", F.coalesce(F.sum("bytes").over(every.rowsBetween(*_BEFORE)), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("rows").over(every.rowsBetween(*_BEFORE)), F.lit(0)).alias("r0"),
        F.sum("bytes").over(every.rowsBetween(*_EVERY)).alias("total"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(*_BEFORE)
    placed = ranged.select(
        *keys, "part", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("b"),
        F.count("*").over(inside).alias("r")).join(F.broadcast(parts), "part")
    # The shard in which the middle of the document's bytes falls.
    middle = (2 * (F.col("b0") + F.col("b")) + F.col("size")).cast("decimal(38,0)")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total"))))
    placed = placed.select(*keys, shard.cast("int").alias("shard"),
                           (F.col("r0") + F.col("r")).alias("place"))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        *keys, "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs, path, shards=SHARDS):
    """Write ``docs`` below ``path``, a folder per shard, rows in slot order within files."""
    row, shard, slot = fresh(docs, "row", "shard", "slot")
    # Written once: numbers made again might be others.
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    where = assign(docs.select("doc_id", "text", row), shards, row).select(
        F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = docs.join(where, row).drop(row)
    # A shard spans many tasks and files; each holds a stretch of its slots.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(max(n, shards), shard, slot).sortWithinPartitions(shard, slot) \
        .write.partitionBy(shard).parquet(path)
    return path


def op8_sharding(spark, sf_dir):
    """All documents in shards 0 to 7 of near equal byte size."""
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
