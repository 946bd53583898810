"""Reading, storing and appending columns; shared by the operators of this package."""

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import settle, workspace

BATCH_ROWS = 256  # rows handled at once: texts may be long
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_ready = set()


def ready(spark):
    """Settle the session and send the package to the executors, once an application, so tasks find
    it wherever the driver was started. No other setting of the session is changed."""
    settle(spark)
    context = spark.sparkContext
    if context.applicationId in _ready:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(top):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.join(name, os.path.relpath(full, top)))
    context.addPyFile(path)  # the driver hands it out; executors need no access to this folder
    _ready.add(context.applicationId)


def table(spark, sf_dir, name):
    """One of the given tables."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df, name):
    """Written below the shared folder and read back: cuts the lineage, survives lost executors.

    What the write shuffled is of no use once it has ended, so Spark removes it then rather than
    when the driver happens to collect its garbage. The session's own setting comes back.
    """
    spark = df.sparkSession
    path = workspace(spark, f"llm-{name}")
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df, *names):
    """Names that no column of ``df`` has, whatever its extra columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_kept = {}


def kept(key, make):
    """What a worker of Python keeps from task to task, made once. Only what was asked for last:
    workers live through one operator after the other, and what each of them keeps adds up."""
    if key not in _kept:
        _kept.clear()  # first, so that the new one finds its room free
        _kept[key] = make()
    return _kept[key]


def slices(batches):
    """Arrow batches of at most ``BATCH_ROWS`` rows; Spark bounds the bytes of those it sends."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def returning(run):
    """``run``, which makes a task's batches; at its end, what Arrow holds without use goes back to
    the system. A worker would keep the most that it ever took through all later tasks."""
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def appended(df, reads, fields, function):
    """``df`` with more columns, computed in batches from the columns ``reads``.

    ``fields``: DDL of the new columns. ``function()`` runs once per task and returns a function of
    the lists of the columns read, which returns the lists of the new columns.
    """
    from pyspark.sql.types import StructType

    ready(df.sparkSession)
    new = StructType.fromDDL(fields)
    schema = StructType(df.schema.fields + new.fields)
    kinds = list(to_arrow_schema(new))
    places = [df.columns.index(c) for c in reads]
    names = schema.fieldNames()

    def run(batches):
        compute = function()
        for batch in slices(batches):
            made = compute(*[batch.column(i).to_pylist() for i in places])
            columns = [pa.array(v, k.type) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=names)

    return df.mapInArrow(returning(run), schema)


def mapped(df, fields, function):
    """New rows from batches: ``function`` gets the iterator of lists of columns and yields lists
    of columns of the DDL ``fields``."""
    from pyspark.sql.types import StructType

    ready(df.sparkSession)
    schema = StructType.fromDDL(fields)
    kinds = list(to_arrow_schema(schema))

    def run(batches):
        lists = ([c.to_pylist() for c in b.columns] for b in slices(batches))
        for made in function(lists):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k.type) for v, k in zip(made, kinds)], names=schema.fieldNames())

    return df.mapInArrow(returning(run), schema)


def part_number():
    """Number of the running task's partition."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def unsigned(column):
    """A CRC-32 of text as an unsigned long; null text counts as empty."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))
