"""Measured storage footprint by file format."""

from pyspark.sql import functions as F

from ..functions.measures import megabytes


def storage_footprint(spark, path, baseline="json"):
    """Files, bytes and megabytes per suffix, and the saving against ``baseline``.

    Only path and length are read; file contents are pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).alias("format"), "length")
    )
    sizes = files.groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    against = files.filter(F.col("format") == baseline).agg(F.sum("length")).scalar()
    return sizes.select(
        "format",
        "files",
        "bytes",
        megabytes("bytes").alias("mb"),
        F.round((1 - F.try_divide(F.col("bytes"), against)) * 100, 1).alias("savings_percent"),
    )
