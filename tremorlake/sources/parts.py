"""Tables of parts that are replaced whole and committed together.

A part is a folder with two slots. A commit writes the touched parts into the slots that are not
current and then a manifest, one small file, that says which slot of each part is; until it is
there, readers see the parts as they were, and doing the same commit again changes nothing else.
Nothing is deleted and nothing piles up: a table has two folders a part and two manifests, however
often it is written.

The manifest has a row per part (its slot, and statistics of its rows that the table keeps) and one
for the table's own totals. Parts are calendar days, hash buckets or key ranges, so it is small and is
read by the driver.
"""

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import table

PART, SLOT = "part", "slot"
_MANIFEST = f"version bigint, {PART} string, {SLOT} int, stats string, totals string"


class Manifest:
    """``version`` of the last commit (-1 before any), ``slots`` and ``stats`` by part, ``totals``."""

    def __init__(self, version=-1, slots=None, stats=None, totals=None):
        self.version, self.slots = version, slots or {}
        self.stats, self.totals = stats or {}, totals or {}


def manifest(spark, path):
    """The manifest of the last commit."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return Manifest()
    last = rows.agg(F.max("version")).first()[0]
    if last is None:
        return Manifest()
    found = rows.filter(F.col("version") == last).collect()
    parts = [r for r in found if r.part is not None]
    totals = next(json.loads(r.totals) for r in found if r.part is None)
    return Manifest(last, {r.part: r.slot for r in parts},
                    {r.part: json.loads(r.stats) for r in parts}, totals)


def read(spark, path, schema, known, parts=None):
    """Rows of the current parts, or of those of ``parts`` that exist; only their folders are
    opened. ``schema`` is without the part."""
    chosen = known.slots if parts is None else {p: known.slots[p] for p in parts if p in known.slots}
    if not chosen:
        return spark.createDataFrame([], schema).withColumn(PART, F.lit(""))
    places = table(f"{PART} string, {SLOT} int")
    rows = spark.read.schema(StructType(schema.fields + places.fields)).parquet(f"{path}/data")
    either = [[p for p, s in chosen.items() if s == slot] for slot in (0, 1)]
    return rows.filter(
        ((F.col(SLOT) == 0) & F.col(PART).isin(either[0]))
        | ((F.col(SLOT) == 1) & F.col(PART).isin(either[1]))).drop(SLOT)


def commit(rows, path, known, version, touched, totals=None, stats=None):
    """Replace the parts ``touched`` by ``rows`` (which has ``part``) and return the new manifest.

    ``stats``: named aggregates kept for each part. A touched part without rows is gone.
    """
    spark = rows.sparkSession
    new = {p: 1 - known.slots.get(p, 1) for p in touched}
    ones = [p for p, s in new.items() if s]
    if new:
        (
            rows.withColumn(SLOT, F.col(PART).isin(ones).cast("int"))
            .hint("rebalance", F.col(PART))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(PART, SLOT).parquet(f"{path}/data")
        )
    kept = {**{"rows": F.count(F.lit(1))}, **(stats or {})}
    written = {}
    if new:
        back = read(spark, path, rows.drop(PART).schema, Manifest(version, new))
        for r in back.groupBy(PART).agg(*[f.alias(n) for n, f in kept.items()]).collect():
            written[r[PART]] = {n: r[n] for n in kept}
    slots = {**{p: s for p, s in known.slots.items() if p not in new},
             **{p: new[p] for p in written}}
    out = Manifest(version, slots, {**known.stats, **written}, {**known.totals, **(totals or {})})
    out.stats = {p: out.stats[p] for p in slots}
    lines = [(version, p, s, json.dumps(out.stats[p]), None) for p, s in slots.items()]
    lines.append((version, None, None, None, json.dumps(out.totals)))
    (
        spark.createDataFrame(lines, _MANIFEST).coalesce(1)
        .write.mode("overwrite").parquet(f"{path}/manifest/turn={version % 2}")
    )
    return out


def staged(df, path):
    """``df`` evaluated once: written beside the table, in place of what stood there."""
    df.write.mode("overwrite").parquet(f"{path}/stage")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/stage")
