"""Running totals, as-of lookup and rolling counts."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clock import HOUR_MS, to_millis
from ..functions.measures import petajoules
from ..plans.slices import running, with_slice
from ..schemas import table
from ..sources import parts


def running_energy(quakes, slices=None):
    """Each event with the energy released up to it (petajoules) and its running number.

    Order is time, then event id. Call it on the columns you need: all of them travel through
    the one shuffle.
    """
    rows = quakes.withColumn("_pj", petajoules("seismic_energy_joules"))
    out = running(
        rows, F.col("epoch_millis"), "event_id", {"cum_energy_pj": "_pj"}, "cum_events", slices
    )
    return out.drop("_pj")


INDEX = table("event_id string, epoch_millis bigint, pj double, day_pj double, day_number bigint")


def extend_index(quakes, path, version, slices=None):
    """Add events to the stored running totals and return the days that were written.

    The index is a part per day: each event with the energy and number of its day up to it. What
    the days before add is their totals in the manifest, so a new day costs only itself, and an
    event that comes late rewrites its own day and no other. An event that is there is replaced
    (its ``dt`` must be the same). A version that was added before changes nothing.
    """
    spark = quakes.sparkSession
    known = parts.manifest(spark, path)
    if known.version >= version:
        return []
    new = parts.staged(quakes.select(
        "event_id", "epoch_millis", petajoules("seismic_energy_joules").alias("pj"),
        F.col("dt").alias(parts.PART)), f"{path}/new")
    days = sorted(r[0] for r in new.select(parts.PART).distinct().collect())
    columns = ["event_id", "epoch_millis", "pj", parts.PART]
    old = parts.read(spark, path, INDEX, known, days).select(*columns, F.lit(0).alias("load"))
    both = old.unionByName(new.withColumn("load", F.lit(1)))
    row = F.struct("epoch_millis", "pj")
    both = parts.staged(
        both.groupBy("event_id", parts.PART).agg(F.max_by(row, "load").alias("kept"))
        .select("event_id", "kept.*", parts.PART), f"{path}/days")
    # Over the written days together, however busy one is; each then starts at its own zero.
    ran = running(both, F.col("epoch_millis"), "event_id", {"run": "pj"}, "number", slices)
    ran = parts.staged(ran, f"{path}/ran")
    starts = ran.groupBy(parts.PART).agg(
        (F.min("number") - 1).alias("n0"), F.min_by(F.col("run") - F.col("pj"), "number").alias("e0"))
    rows = ran.join(F.broadcast(starts), parts.PART).select(  # a row per written day
        "event_id", "epoch_millis", "pj", (F.col("run") - F.col("e0")).alias("day_pj"),
        (F.col("number") - F.col("n0")).alias("day_number"), parts.PART)
    parts.commit(rows, path, known, version, days, stats={"pj": F.sum("pj")})
    return days


def running_index(spark, path, since=None):
    """Events of the index with ``cum_energy_pj`` and ``cum_events`` over all days; with ``since``
    (a day) only the days from it on are opened."""
    known = parts.manifest(spark, path)
    starts, energy, number = [], 0.0, 0
    for day in sorted(known.stats):
        starts.append((day, energy, number))
        energy, number = energy + known.stats[day]["pj"], number + known.stats[day]["rows"]
    chosen = [day for day, _, _ in starts if since is None or day >= since]
    before = spark.createDataFrame(starts, table(f"{parts.PART} string, pj0 double, n0 bigint"))
    rows = parts.read(spark, path, INDEX, known, chosen)
    return rows.join(F.broadcast(before), parts.PART).select(  # a row per day
        "event_id", "epoch_millis", (F.col("pj0") + F.col("day_pj")).alias("cum_energy_pj"),
        (F.col("n0") + F.col("day_number")).alias("cum_events"))


def event_number(quakes, slices=None):
    """Each event with its running number in the order of time and event id."""
    return running(quakes, F.col("epoch_millis"), "event_id", {}, "cum_events", slices)


def first_at_or_after(quakes, instants):
    """For each instant the first event at or after it; instants after the last event drop out.

    Each event falls in one interval between instants; the least time of each interval is a
    plain hash aggregate, and an interval without events takes the next one's. Only events
    of those few times are then looked at whole. No event is paired with every instant, and
    what is broadcast is the caller's list.
    """
    millis = sorted({to_millis(i) for i in instants})
    spark = quakes.sparkSession
    if not millis:
        others = [c for c in quakes.columns if c != "epoch_millis"]
        return quakes.limit(0).select(
            F.col("epoch_millis").alias("instant_millis"), "epoch_millis", *others
        )
    reachable = quakes.filter(F.col("epoch_millis") >= F.lit(millis[0]))
    firsts = (
        with_slice(reachable, F.col("epoch_millis"), [float(m) for m in millis], "_interval")
        .groupBy("_interval").agg(F.min("epoch_millis").alias("epoch_millis"))
    )
    later = W.orderBy(F.desc("_interval")).rowsBetween(W.unboundedPreceding, 0)
    wanted = (
        spark.createDataFrame(
            [(i + 1, m) for i, m in enumerate(millis)], "_interval int, instant_millis bigint"
        )
        .join(firsts, "_interval", "left")
        .select("instant_millis", F.last("epoch_millis", True).over(later).alias("epoch_millis"))
        .filter(F.col("epoch_millis").isNotNull())
    )
    event = F.struct(*[c for c in quakes.columns if c != "epoch_millis"])
    return (
        reachable.join(F.broadcast(wanted), "epoch_millis")
        .groupBy("instant_millis", "epoch_millis")
        .agg(F.min_by(event, "event_id").alias("event"))
        .select("instant_millis", "epoch_millis", "event.*")
    )


def rolling_counts(quakes, hours=(1, 6, 24), by="region"):
    """Per region and instant with events: events of that instant (``events``) and of the
    last 1, 6 and 24 hours up to and including it (``last_1h`` ..).

    A range window per region would put a whole region in one task. A window of ``w`` hours
    ending at an instant is: its own hour up to it, the whole hours between, and the end of
    the hour ``w`` before. Whole hours come from an hourly count; the two partial hours are
    counted inside cells of one region and hour, where equal instants are already merged, so
    a cell has at most as many rows as an hour has milliseconds, per window.
    """
    instants = quakes.groupBy(by, "epoch_millis").agg(F.count(F.lit(1)).alias("events"))
    timed = instants.select(
        by,
        "events",
        F.floor(F.col("epoch_millis") / HOUR_MS).alias("hour"),
        F.pmod("epoch_millis", F.lit(HOUR_MS)).alias("offset"),
    )
    hourly = quakes.groupBy(
        by, F.floor(F.col("epoch_millis") / HOUR_MS).alias("hour")
    ).agg(F.count(F.lit(1)).alias("n"))
    per_region = W.partitionBy(by).orderBy("hour")
    whole = hourly.select(
        by,
        "hour",
        *[
            # Hours h-w .. h-1: those between and the one partly inside.
            F.coalesce(F.sum("n").over(per_region.rangeBetween(-w, -1)), F.lit(0)).alias(f"_full_{w}")
            for w in hours
        ],
    )
    lags = F.array(F.lit(0), *[F.lit(w) for w in hours])
    cells = timed.select("*", F.explode(lags).alias("lag")).withColumn(
        "hour", F.col("hour") + F.col("lag")
    )
    in_cell = W.partitionBy("hour", by).orderBy("offset")  # the number first sorts faster
    upto = in_cell.rangeBetween(W.unboundedPreceding, 0)
    below = in_cell.rangeBetween(W.unboundedPreceding, -1)
    counted = cells.select(
        by, "hour", "offset", "events", "lag",
        F.sum(F.when(F.col("lag") == 0, F.col("events"))).over(upto).alias("_own"),
        *[
            # Events of the hour w before that are too old.
            F.coalesce(
                F.sum(F.when(F.col("lag") == w, F.col("events"))).over(below), F.lit(0)
            ).alias(f"_old_{w}")
            for w in hours
        ],
    ).filter(F.col("lag") == 0)
    return counted.join(whole, ["hour", by]).select(
        by,
        (F.col("hour") * HOUR_MS + F.col("offset")).alias("epoch_millis"),
        "events",
        *[
            (F.col("_own") + F.col(f"_full_{w}") - F.col(f"_old_{w}")).alias(f"last_{w}h")
            for w in hours
        ],
    )
