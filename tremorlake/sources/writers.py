"""Writers of the landing, processed and rollup zones, and compaction.

Processed tables are written after ``rebalance``: rows of a partition value meet in few
files, and a value that holds far more rows than others is split over several tasks by
adaptive execution, so one busy day is never one task's work.
"""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions.clock import to_millis
from ..schemas import BUNDLE, FEATURE, GEOMETRY, LANDING_KEYS, PROPERTIES
from .readers import read_landed

ORC_BLOOM = "region,alert_level,tsunami_flag"  # fixed value


def ingestion_instant(ingested_at=None):
    """The batch's ingestion time as a column: a given instant or now."""
    if ingested_at is None:
        return F.current_timestamp()
    return F.timestamp_millis(F.lit(to_millis(ingested_at)))


def with_landing_keys(df, instant):
    for key, pattern in zip(LANDING_KEYS, ("yyyy", "MM", "dd", "HH")):
        df = df.withColumn(key, F.date_format(instant, pattern))
    return df


DOCUMENT_FEATURES = 10_000  # of a landed document, at most

# A feature goes to Python as four arrays: Spark measures each Arrow vector of a batch after every
# row, and a feature as it is has 26. Packed type and Arrow type by the type of a property.
_PACKS = {"string": ("texts", pa.string()), "double": ("numbers", pa.float64()),
          "bigint": ("whole", pa.int64()), "int": ("whole", pa.int32())}
_KINDS = {f.name: _PACKS[f.dataType.simpleString()] for f in PROPERTIES}


def _packed(features):
    """Features as arrays of their texts, numbers, whole numbers and coordinates."""
    packs = {"texts": [F.col("id"), F.col("geometry.type")], "numbers": [],
             "whole": [F.isnotnull(c).cast("bigint") for c in ("properties", "geometry")]}
    for name, (pack, _) in _KINDS.items():
        value = F.col(f"properties.{name}")
        packs[pack].append(value.cast("bigint") if pack == "whole" else value)
    return features.select(
        *[F.array(*values).alias(pack) for pack, values in packs.items()],
        F.col("geometry.coordinates").alias("coordinates"))


def _unpacking():
    """The function that makes features of a batch of ``_packed`` rows, as one Arrow array.

    It is sent to the tasks whole: executors need not have this package.
    """
    kinds, names, places = _KINDS, FEATURE.fieldNames(), GEOMETRY.fieldNames()

    def unpacked(batch):
        at = {"texts": 0, "numbers": 0, "whole": 0}

        def following(pack, kind):
            values = pc.list_element(batch.column(pack), at[pack])
            at[pack] += 1
            return values.cast(kind)

        id, shape = (following("texts", pa.string()) for _ in range(2))
        no_properties, no_geometry = (
            pc.equal(following("whole", pa.int64()), 0) for _ in range(2))
        properties = pa.StructArray.from_arrays(
            [following(*kind) for kind in kinds.values()], list(kinds), mask=no_properties)
        geometry = pa.StructArray.from_arrays(
            [shape, batch.column("coordinates")], places, mask=no_geometry)
        return pa.StructArray.from_arrays([id, properties, geometry], names)

    return unpacked


def bundle(features, most=DOCUMENT_FEATURES):
    """Group features into documents of at most ``most``.

    A task's features fill one document after another; small tasks are merged first, so an
    ingestion that fits one document becomes one. No group of features is ever collected.
    """
    unpacked = _unpacking()

    def document(rows):
        whole = pa.array([0, len(rows)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([len(rows)], pa.int32()), pa.ListArray.from_arrays(whole, rows)],
            names=["batch_count", "features"],
        )

    def documents(batches):
        held, n = [], 0
        for batch in batches:
            at, features = 0, unpacked(batch)
            while at < len(features):
                rows = features.slice(at, most - n)
                held.append(rows)
                at, n = at + len(rows), n + len(rows)
                if n == most:
                    yield document(pa.concat_arrays(held))
                    held, n = [], 0
        if held:
            yield document(pa.concat_arrays(held))

    # Dealt by id: dealing in turn would first sort every row of a task.
    one = features.select(*FEATURE.fieldNames()).hint("rebalance", F.col("id"))
    return _packed(one).mapInArrow(documents, BUNDLE)


def land_features(features, path, ingested_at=None, form="documents", title=None,
                  most=DOCUMENT_FEATURES):
    """Append features below the hour in which they were ingested (UTC).

    ``documents`` writes feature collections of at most ``most`` features, one a file, ``lines``
    one feature per line. Each form has its own tree, so no event is counted twice. ``batch_count``
    and ``metadata.count`` are the document's own features, so the counts of an ingestion add up
    (``readers.landed_documents``); ``features`` is evaluated once.
    """
    instant = ingestion_instant(ingested_at)
    if form == "lines":
        rows = with_landing_keys(features.select(*FEATURE.fieldNames()), instant)
        rows.write.mode("append").partitionBy(*LANDING_KEYS).json(path)
        return
    rows = bundle(features, most).select(
        F.lit("FeatureCollection").alias("type"),
        F.struct(
            F.unix_millis(instant).alias("generated"),
            F.lit(title).cast("string").alias("title"),
            F.col("batch_count").alias("count"),
        ).alias("metadata"),
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ingested_at"),
        "batch_count",
        "features",
    )
    (
        with_landing_keys(rows, instant)
        .write.mode("append").partitionBy(*LANDING_KEYS)
        .option("maxRecordsPerFile", 1)
        .json(path)
    )


def write_quakes(quakes, path, fmt="parquet", mode="overwrite"):
    """Write the processed table, ``dt=`` folders, replacing only the days it carries."""
    if fmt == "csv":
        quakes.write.mode(mode).option("header", "true").csv(path)
        return
    writer = (
        quakes.hint("rebalance", F.col("dt"))
        .sortWithinPartitions("dt", "epoch_millis")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy("dt")
    )
    if fmt == "orc":
        writer = writer.option("orc.bloom.filter.columns", ORC_BLOOM)
    writer.format(fmt).save(path)


def write_tsv(rows, path, sep="\t"):
    rows.write.mode("overwrite").option("sep", sep).csv(path)


def export_rollup(rollup, path, order_by=None, fmt="csv"):
    """One file per rollup, in the order of the named columns ("-name" is descending). A rollup has a row per bucket, region or class: it is small,
    and the single partition starts after its aggregation, not before."""
    order = [
        F.desc(name[1:]) if name.startswith("-") else F.col(name)
        for name in order_by or rollup.columns[:1]
    ]
    one = rollup.repartition(1).sortWithinPartitions(*order)
    one.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def write_summary(one_row, path):
    """A one-record JSON summary."""
    one_row.coalesce(1).write.mode("overwrite").json(path)


def compact(spark, landed_path, path, fmt="parquet", form="documents"):
    """Small landed files to columnar days: flatten, keep one copy per event, rewrite.

    ``form`` is the landed form, see ``land_features``.
    """
    from ..operators.cleansing import dedup, drop_incomplete, flatten

    features = drop_incomplete(read_landed(spark, landed_path, form))
    write_quakes(flatten(dedup(features)), path, fmt)
