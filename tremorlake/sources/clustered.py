"""The processed table along a space-filling curve.

``dt=`` folders prune by day only. Here rows are ordered by a curve through magnitude, depth and
time, so each file (and row group) covers a small box of all three, and a selection on any of
them skips most row groups by their statistics. Every column is cut into 2^bits slices at its
own quantiles, so crowded magnitudes get as many slices as they have rows; the slice numbers'
bits, dealt in turn, are the place on the curve. Rows with nulls are kept like all others; where they
lie is not defined.
"""

from functools import reduce

from pyspark.sql import functions as F

from ..plans.slices import sketched_cuts, with_slice

CURVE = ("magnitude", "depth_km", "epoch_millis")
BITS = 5


def curve_place(numbers, bits=BITS):
    """The bits of the slice numbers, highest first, one of each column in turn."""
    n = len(numbers)
    dealt = [
        F.shiftleft(F.shiftright(number, bit).bitwiseAND(F.lit(1)), bit * n + n - 1 - k)
        for bit in range(bits) for k, number in enumerate(numbers)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), dealt)


def write_clustered(quakes, path, columns=CURVE, bits=BITS, files=None):
    """Overwrite ``path`` with the rows in curve order.

    ``files`` fixes the number of files; without it they follow the size of the data. Finding the
    slices reads each of the columns once, so ``quakes`` should be a written table.
    """
    rows, names = quakes, [f"_cell_{k}" for k in range(len(columns))]
    for name, column in zip(names, columns):
        cuts = sketched_cuts(quakes, F.col(column).cast("double"), 2 ** bits)
        rows = with_slice(rows, F.col(column), cuts, name)
    rows = rows.withColumn("_place", curve_place([F.col(n).cast("bigint") for n in names], bits))
    by = (files, "_place") if files else ("_place",)
    rows.repartitionByRange(*by).sortWithinPartitions("_place").drop("_place", *names) \
        .write.mode("overwrite").option("compression", "snappy").parquet(path)
