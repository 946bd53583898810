"""Frequency-magnitude law, histograms, spikes, percentiles, correlation, energy share."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import bucket, event_time
from ..plans.slices import SLICE, sketched_cuts, with_slice

# Magnitude thresholds, the fitted range, spike factor, histogram bins.
THRESHOLDS = (5.0, 8.3, 0.1)
FIT_RANGE = (5.0, 7.5)
SPIKE_SIGMAS = 1.8
HOURLY_SPIKE_SIGMAS = 2.0
HISTOGRAM_BINS = 35


def magnitude_step(low=THRESHOLDS[0], high=THRESHOLDS[1], step=THRESHOLDS[2]):
    """Number of the highest threshold an event reaches, null below the lowest.

    A small nudge makes 5.1 reach the 5.1 step whatever its binary form.
    """
    place = F.floor((F.col("magnitude") - F.lit(low)) / F.lit(step) + F.lit(1e-6))
    return F.when(
        F.col("magnitude") >= F.lit(float(low)), F.least(place, F.lit(round((high - low) / step)))
    )


def cumulative_counts(counts, low=THRESHOLDS[0], high=THRESHOLDS[1], step=THRESHOLDS[2]):
    """``N(>= m)`` and its logarithm from the counts (``n``) per ``step`` number; thresholds
    nobody reaches drop out. It sums the few dozen counts from the top."""
    above = W.orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, 0)
    return (
        counts.sparkSession.range(round((high - low) / step) + 1)
        .withColumnRenamed("id", "step")
        .join(counts, "step", "left")
        .select("step", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("cumulative_count"))
        .filter(F.col("cumulative_count") > 0)
        .select(
            F.round(F.lit(low) + F.col("step") * F.lit(step), 2).alias("magnitude"),
            "cumulative_count",
            F.log10("cumulative_count").alias("log10_count"),
        )
        .orderBy("magnitude")
    )


def frequency_magnitude(quakes, low=THRESHOLDS[0], high=THRESHOLDS[1], step=THRESHOLDS[2]):
    """The cumulative frequency-magnitude table in one scan: events are counted per step."""
    counts = (
        quakes.filter(F.col("magnitude") >= F.lit(float(low)))
        .groupBy(magnitude_step(low, high, step).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cumulative_counts(counts, low, high, step)


def _fit(frequencies, low, high):
    x, y = F.col("magnitude"), F.col("log10_count")
    # Half a hundredth keeps both end thresholds inside.
    chosen = frequencies.filter(x.between(low - 0.005, high + 0.005))
    return chosen.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("points"),
    )


def power_law(frequencies, low=FIT_RANGE[0], high=FIT_RANGE[1]):
    """One row: ``log10 N = a_value - b_value * M`` fitted by least squares, with R²."""
    return _fit(frequencies, low, high).select(
        (-F.col("slope")).alias("b_value"), F.col("intercept").alias("a_value"), "r2", "points"
    )


def fit_power_law(frequencies, low=FIT_RANGE[0], high=FIT_RANGE[1]):
    """Each threshold with the fitted line, and the parameters repeated."""
    line = _fit(frequencies, low, high).select(F.struct("slope", "intercept", "r2")).scalar()
    return (
        frequencies.withColumn("fit", line)
        .select(
            "magnitude",
            "log10_count",
            (F.col("fit.intercept") + F.col("fit.slope") * F.col("magnitude")).alias("fitted"),
            (-F.col("fit.slope")).alias("b_value"),
            F.col("fit.intercept").alias("a_value"),
            F.col("fit.r2").alias("r2"),
        )
    )


def spikes_of(counts, window, count="total_events", sigmas=SPIKE_SIGMAS):
    """Counts with mean, threshold (mean + ``sigmas`` sample deviations) and a flag."""
    level = counts.agg(
        F.struct(F.avg(count).alias("mean"), F.stddev_samp(count).alias("sigma"))
    ).scalar()
    return (
        counts.select(window, count).withColumn("level", level)
        .select(
            window,
            count,
            F.col("level.mean").alias("mean_events"),
            (F.col("level.mean") + F.lit(float(sigmas)) * F.col("level.sigma")).alias("threshold"),
        )
        .withColumn("is_spike", F.coalesce(F.col(count) > F.col("threshold"), F.lit(False)))
    )


def spikes(quakes, unit="week", sigmas=SPIKE_SIGMAS, fill_gaps=False):
    """Spikes of the event count per week or hour.

    Buckets without events are absent; ``fill_gaps`` counts them as zero.
    """
    window = f"{unit}_window"
    counts = quakes.groupBy(bucket(event_time("epoch_millis"), unit).alias(window)).agg(
        F.count(F.lit(1)).alias("total_events")
    )
    if fill_gaps:
        ends = counts.agg(F.min(window).alias("a"), F.max(window).alias("b"))
        every = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias(window))
        counts = every.join(counts, window, "left").na.fill(0, ["total_events"])
    return spikes_of(counts, window, sigmas=sigmas)


def histogram(quakes, column, bins=HISTOGRAM_BINS):
    """Equal-width counts between the least and largest value; empty bins are 0.

    The edges decide: bin ``i`` holds ``lower <= value < upper``, the last bin its upper edge
    too. The division only guesses the bin, which is then moved to where the edges put it.
    """
    value = F.col(column)
    known = quakes.filter(value.isNotNull()).select(value.alias("v"))
    least, most = F.min("v"), F.max("v")
    half = F.when(least == most, 0.5).otherwise(0.0)  # a single value gets a unit range
    span = known.agg(F.struct((least - half).alias("lo"), (most + half).alias("hi"))).scalar()
    step = (F.col("s.hi") - F.col("s.lo")) / F.lit(bins)

    def edge(number):
        return F.col("s.lo") + number * step

    guess = F.least(F.floor((F.col("v") - F.col("s.lo")) / step), F.lit(bins - 1))
    moved = F.col("guess") - (F.col("v") < edge(F.col("guess"))).cast("int") + (
        (F.col("v") >= edge(F.col("guess") + 1)) & (F.col("guess") < bins - 1)
    ).cast("int")
    counts = (
        known.withColumn("s", span)
        .withColumn("guess", guess)
        .groupBy(moved.alias("bin"))
        .agg(F.count(F.lit(1)).alias("event_count"))
    )
    return (
        quakes.sparkSession.range(bins).withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .withColumn("s", span)
        .select(
            F.col("bin").cast("int").alias("bin"),
            edge(F.col("bin")).alias("lower"),
            edge(F.col("bin") + 1).alias("upper"),
            F.coalesce("event_count", F.lit(0)).alias("event_count"),
        )
        .orderBy("bin")
    )


PERCENTILES = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))  # fixed values


def latency_summary(measurements, group, metric, percentiles=PERCENTILES, slices=None):
    """Per group: count, mean and exact percentiles (linear interpolation).

    The built-in exact percentile keeps every distinct value of a group in one buffer.
    Here the value axis is cut into slices by a quantile sketch (the first scan), equal values
    are counted together (the second), and only the slices that contain a wanted rank are
    ranked, each on its own. The cuts balance the work; the results are exact whatever they are.
    """
    rows = measurements.select(
        F.col(group).alias("g"), F.col(metric).cast("double").alias("v")
    ).filter(F.col("v").isNotNull())
    cuts = sketched_cuts(rows, "v", slices)
    values = with_slice(
        rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), F.col("v"), cuts
    )
    totals = values.groupBy("g", SLICE).agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("t"))
    whole = W.partitionBy("g")
    placed = totals.select(
        "g",
        SLICE,
        F.coalesce(
            F.sum("n").over(whole.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        "n",
        F.sum("n").over(whole).alias("size"),
    )
    rank = F.col("p") * (F.col("size") - 1)
    wanted = placed.select(
        "*",
        F.explode(F.array(*[F.lit(p) for _, p in percentiles])).alias("p"),
    ).select(
        "g", SLICE, "before", "n", "p", (rank - F.floor(rank)).alias("part"),
        F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("rank"),
    ).filter(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    ).select("g", SLICE, "before", "p", "part", "rank").distinct()

    targets = wanted.groupBy("g", SLICE, "before").agg(F.collect_set("rank").alias("ranks"))
    inside = W.partitionBy("g", SLICE).orderBy("v")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    found = (
        values.join(targets, ["g", SLICE])
        .withColumn("end", F.col("before") + F.sum("n").over(upto))
        .withColumn("rank", F.explode("ranks"))
        .filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
        .select("g", "rank", "v")
    )
    exact = (
        wanted.join(found, ["g", "rank"])
        .groupBy("g", "p")
        .agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.max("part").alias("part")
        )
        .select("g", "p", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(
            F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))
        .groupBy("g").agg(*[
            F.max(F.when(F.col("p") == p, F.col("q"))).alias(name) for name, p in percentiles
        ])
    )
    means = totals.groupBy("g").agg(
        F.sum("n").alias("runs"), (F.sum("t") / F.sum("n")).alias("mean")
    )
    return means.join(exact, "g").select(
        F.col("g").alias(group), "runs", "mean", *[name for name, _ in percentiles]
    )


def mean_ratio(summary, group, slow, fast):
    """How many times the mean of group ``slow`` is that of ``fast`` (1.0 if that is 0)."""
    slow_mean = F.max(F.when(F.col(group) == slow, F.col("mean")))
    fast_mean = F.max(F.when(F.col(group) == fast, F.col("mean")))
    return summary.agg(
        F.when(fast_mean > 0, slow_mean / fast_mean).otherwise(F.lit(1.0)).alias("ratio")
    )


def mag_depth_corr(quakes, by=None):
    measures = [
        F.count(F.lit(1)).alias("event_count"),
        F.corr("magnitude", "depth_km").alias("correlation"),
    ]
    return quakes.groupBy(by).agg(*measures) if by else quakes.agg(*measures)


def energy_share(quakes, k=4):
    """Share of all radiated energy that the ``k`` largest events account for."""
    top = (
        quakes.select("seismic_energy_joules", "event_id")
        .orderBy(F.desc("seismic_energy_joules"), "event_id").limit(k)
        .agg(F.sum("seismic_energy_joules")).scalar()
    )
    return quakes.agg(
        F.sum("seismic_energy_joules").alias("total_energy_joules")
    ).withColumn("top_energy_joules", top).withColumn(
        "share", F.try_divide("top_energy_joules", "total_energy_joules")
    )
