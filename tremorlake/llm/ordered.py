"""Places and sums of the rows before, in the order of a group of any size."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import fresh, stored

_BEFORE = (Window.unboundedPreceding, -1)
_EVERY = (Window.unboundedPreceding, Window.unboundedFollowing)


def running(df, group, order, sums=(), name="ranged"):
    """``df`` with ``pos`` (rows before in the group), ``n`` (rows of the group) and, for each
    column c of ``sums``, ``c_before`` (its sum over the rows before) and ``c_all``.

    Rows are ranged by group and order, so a group that holds most rows spans many ranges. The
    totals of a range (a row per range and group in it) are summed over the ranges of a group, and
    a row adds what lies before it in its own range. Group columns hold no nulls; rows equal in all
    keys are told apart by their input row.
    """
    part, row, first = fresh(df, "part", "row", "first")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, row]
    ranged = stored(
        df.withColumn(row, F.monotonically_increasing_id())
        .repartitionByRange(n, *group, *keys).withColumn(part, F.spark_partition_id()), name)
    counted = {"pos": F.count("*"), **{c: F.sum(c) for c in sums}}
    own = ranged.groupBy(part, *group).agg(*[f.alias(c) for c, f in counted.items()])
    ranges = Window.partitionBy(*group).orderBy(part)

    def named(c, end):
        return {"before": first, "all": "n"}[end] if c == "pos" else f"{c}_{end}"

    starts = own.select(part, *group, *[
        F.coalesce(F.sum(c).over(ranges.rowsBetween(*frame)), F.lit(0)).alias(named(c, end))
        for c in counted for end, frame in (("before", _BEFORE), ("all", _EVERY))])
    inside = Window.partitionBy(part, *group).orderBy(*keys).rowsBetween(*_BEFORE)
    placed = ranged.withColumns({
        f"{row}{k}": F.coalesce((F.count("*") if c == "pos" else F.sum(c)).over(inside), F.lit(0))
        for k, c in enumerate(counted)})
    # One row per range and group on the right, and no range holds more than its share.
    joined = placed.join(starts, [part, *group])
    return joined.select(*df.columns, (F.col(f"{row}0") + F.col(first)).alias("pos"), "n", *[
        x for k, c in enumerate(sums, 1) for x in (
            (F.col(f"{row}{k}") + F.col(f"{c}_before")).alias(f"{c}_before"), F.col(f"{c}_all"))])
