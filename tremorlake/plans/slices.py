"""Ordered slices: global running totals and ranks without a single-task window.

A window without partition keys runs in one task. Here the order key is cut at its own
quantiles into ``n`` slices of about equal size, so no calendar bucket, however busy, decides
how much one task gets. Slice totals (``n`` rows) give each slice its starting value, and the
running part is a window inside the slice.
"""

from collections import Counter
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE = "_slice"
ROWS_PER_SLICE = 2_000_000
SAMPLED_PER_SLICE = 200
SAMPLED_TIES = 50
SKETCH_K = 16_384  # size of the sketch of the cuts: ranks within about 0.03 % of the rows


def default_slices(spark):
    """A few slices per shuffle task, so hashing them to tasks stays even."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def quantiles(df, key, slices=None):
    """Cuts of ``key`` into slices of about equal size, with repeats where one value spans
    several, and the number of rows.

    ``slices`` defaults to a few per shuffle task, and more where that leaves over
    ROWS_PER_SLICE rows in one. The cuts come from a sample of some hundred rows per slice;
    they only balance the slices: whatever they are, every row falls in one and the results
    are exact. Runs two small jobs over the key, so ``df`` should be a written table.
    """
    rows = df.count() if slices != 1 else 0
    slices = slices or max(default_slices(df.sparkSession), -(-rows // ROWS_PER_SLICE))
    if not rows or slices <= 1:
        return [], rows
    share = SAMPLED_PER_SLICE * slices / rows
    sample = df.sample(share, seed=17) if share < 1 else df
    shares = [i / slices for i in range(1, slices)]
    row = sample.agg(F.percentile_approx(key, shares, 10 * slices).alias("cuts")).first()
    return sorted(float(c) for c in row.cuts or ()), rows


def sketched_cuts(df, key, slices=None):
    """Distinct cuts of ``key`` into slices of about equal size from one mergeable KLL sketch.

    One aggregate over ``df`` gives the number of rows and the sketch (some 400 kB whatever the
    input), so the input is read once, needs no sample and may be any plan. As in ``quantiles``
    the cuts only balance: at most SKETCH_K / 8 slices, further than that they would repeat.
    """
    if slices == 1:
        return []
    sketch = F.kll_sketch_agg_double(key, F.lit(SKETCH_K)).alias("sketch")
    row = df.agg(sketch).select("sketch", F.kll_sketch_get_n_double("sketch").alias("rows")).first()
    if not row.rows:
        return []
    most = max(default_slices(df.sparkSession), -(-row.rows // ROWS_PER_SLICE))
    slices = min(slices or most, SKETCH_K // 8)
    if slices <= 1:
        return []
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    found = df.sparkSession.range(1).select(
        F.kll_sketch_get_quantile_double(F.lit(row.sketch), shares).alias("cuts")).first()
    return sorted({c for c in found.cuts if isfinite(c)})


def with_slice(df, key, cuts, name=SLICE):
    """Add the slice number; it grows with ``key``."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    inf = float("inf")
    assign = Bucketizer(
        splits=[-inf, *cuts, inf], inputCol="_key", outputCol="_bucket", handleInvalid="keep"
    )
    keyed = assign.transform(df.withColumn("_key", key.cast("double")))
    # Never null, so a join on it needs no second evaluation to filter nulls.
    number = F.coalesce(F.col("_bucket").cast("int"), F.lit(0))
    return keyed.withColumn(name, number).drop("_key", "_bucket")


def _tie_cuts(df, key, tie, cuts, rows):
    """For each value that several cuts fell on, cuts of its ties.

    Taken from a sample of some rows per slice of those values only.
    """
    spans = {c: n for c, n in Counter(cuts).items() if n > 1}
    if not spans:
        return {}
    share = min(1.0, SAMPLED_TIES * (len(cuts) + 1) / max(rows, 1))
    crowded = df.select(key.alias("key"), F.col(tie).alias("tie")).filter(
        F.col("key").isin(list(spans))
    )
    found = {c: [] for c in spans}
    for row in crowded.sample(share, seed=23).collect() if share < 1 else crowded.collect():
        found[row.key].append(row.tie)
    out = {}
    for value, ties in found.items():
        ties, n = sorted(t for t in ties if t is not None), spans[value] + 1
        out[value] = sorted({ties[len(ties) * i // n] for i in range(1, n)}) if ties else []
    return out


def sliced(df, millis, tie, slices=None):
    """Slice by (``millis``, ``tie``). Returns the frame and its order columns.

    Slices are cut at instants; an instant that holds more than a slice is cut again by
    ``tie``, so even all events at one instant spread over slices.
    """
    keyed = df.withColumn("_order", millis)
    key = F.col("_order").cast("double")
    cuts, rows = quantiles(keyed, key, slices)
    crowded = _tie_cuts(keyed, key, tie, cuts, rows)
    frame = with_slice(keyed, key, sorted(set(cuts)))
    if any(crowded.values()):
        # Inside the slice that starts with the instant: its parts, then what comes after it.
        most = max(len(t) for t in crowded.values()) + 2
        part = F.lit(most - 1)
        for value, ties in crowded.items():
            number = F.size(F.filter(F.array(*map(F.lit, ties)), lambda t: t <= F.col(tie))) \
                if ties else F.lit(0)
            part = F.when(key == value, number).otherwise(part)
        frame = frame.withColumn(SLICE, F.col(SLICE) * most + part)
    return frame, ["_order", tie]


def running(df, millis, tie, sums, number=None, slices=None):
    """Running totals over the whole frame in (``millis``, ``tie``) order.

    ``sums`` maps output names to the columns summed; ``number`` names the running row
    number. The slice table (a row per slice) joins on the slice, by which the rows are
    already partitioned.
    """
    frame, order = sliced(df, millis, tie, slices)
    totals = frame.groupBy(SLICE).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(source).alias(f"_sum_{name}") for name, source in sums.items()],
    )
    before = W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        SLICE,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[
            F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_sum_{n}")
            for n in sums
        ],
    )
    inside = W.partitionBy(SLICE).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    local = frame.select(
        *df.columns,
        SLICE,
        F.row_number().over(inside).alias("_row"),
        *[F.sum(source).over(upto).alias(f"_run_{name}") for name, source in sums.items()],
    )
    joined = local.join(carried, SLICE)
    return joined.select(
        *df.columns,
        *[(F.col(f"_run_{n}") + F.col(f"_sum_{n}")).alias(n) for n in sums],
        *([(F.col("_row") + F.col("_rows")).alias(number)] if number else []),
    )


def newest(df, millis, tie, n, slices=None):
    """The last ``n`` rows in (``millis``, ``tie``) order.

    Slices older than the one in which the count reaches ``n`` are filtered out before
    the ordered limit, so it sees ``n`` rows plus less than one slice.
    """
    frame, order = sliced(df, millis, tie, slices)
    counts = frame.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    newer = W.orderBy(F.desc(SLICE)).rowsBetween(W.unboundedPreceding, -1)
    reached = counts.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
    oldest = reached.filter(F.col("_newer") < n).agg(F.min(SLICE)).scalar()
    kept = frame.filter(F.col(SLICE) >= oldest)
    return kept.orderBy(*[F.desc(c) for c in order]).limit(n).select(*df.columns)
