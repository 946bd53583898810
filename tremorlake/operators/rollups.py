"""Grouped summaries of the processed table.

All are one scan with partial aggregation before the only shuffle, so a region or hour that
holds most rows reaches its reducer as one row per map task.
"""

from pyspark.sql import functions as F

from ..functions.clock import DAY_NAMES, bucket, calendar, event_time
from ..functions.measures import DEPTH_LONG, DEPTH_SHORT, depth_class

ALERT_LEVELS = ("green", "yellow", "orange", "red")  # fixed value: display order
HOT_CELL = 1.15  # fixed value: share of the mean above which a grid cell stands out


def _count(name):
    return F.count(F.lit(1)).alias(name)


def _avg(column, name, digits=None):
    mean = F.avg(column)
    return (mean if digits is None else F.round(mean, digits)).alias(name)


def _max_magnitude():
    return F.max("magnitude").alias("max_magnitude")


def _energy(name="total_energy_joules"):
    return F.sum("seismic_energy_joules").alias(name)


def _time(quakes):
    return event_time("epoch_millis") if "event_time" not in quakes.columns else F.col("event_time")


def activity(quakes, unit="hour", flavour="full"):
    """Events, mean and peak magnitude and energy per hour, day, week or month.

    ``warehouse`` gives the window as text, rounds the mean and starts with the newest.
    """
    window = f"{unit}_window"
    grouped = quakes.groupBy(bucket(_time(quakes), unit).alias(window))
    if flavour == "warehouse":
        rows = grouped.agg(
            _count("total_events"), _avg("magnitude", "avg_magnitude", 2), _max_magnitude(),
            _energy(),
        )
        return rows.withColumn(
            window, F.date_format(window, "yyyy-MM-dd HH:mm:ss")
        ).orderBy(F.desc(window))
    return grouped.agg(
        _count("total_events"), _avg("magnitude", "avg_magnitude"), _max_magnitude(), _energy()
    ).orderBy(window)


def weekly_energy(quakes):
    """Events and energy per week (Monday start)."""
    return (
        quakes.groupBy(bucket(_time(quakes), "week").alias("week_window"))
        .agg(_count("total_events"), _energy())
        .orderBy("week_window")
    )


def hourly_counts(quakes):
    return (
        quakes.groupBy(bucket(_time(quakes), "hour").alias("hour"))
        .agg(_count("count"))
        .orderBy("hour")
    )


def regional_scorecard(quakes, flavour="full"):
    """The risk scorecard, busiest region first."""
    warehouse = flavour == "warehouse"
    energy = F.sum("seismic_energy_joules")
    return (
        quakes.groupBy("region")
        .agg(
            _count("event_count"),
            _avg("magnitude", "avg_magnitude", 2 if warehouse else None),
            _max_magnitude(),
            _avg("depth_km", "avg_depth_km", 1 if warehouse else None),
            F.sum("tsunami_flag").alias(
                "tsunami_warning_count" if warehouse else "tsunami_warnings"
            ),
            F.sum("felt_reports").alias("total_felt_reports"),
            (F.round(energy, 2) if warehouse else energy).alias("cumulative_energy_joules"),
        )
        .orderBy(F.desc("event_count"), "region")
    )


def depth_strata(quakes, flavour="full"):
    warehouse = flavour == "warehouse"
    name = "depth_classification" if warehouse else "depth_category"
    labels = DEPTH_LONG if warehouse else DEPTH_SHORT
    return (
        quakes.groupBy(depth_class("depth_km", labels).alias(name))
        .agg(
            _count("event_count"),
            _avg("magnitude", "avg_magnitude", 2 if warehouse else None),
            _max_magnitude(),
        )
        .orderBy(name)
    )


def diurnal(quakes):
    """Day of week by hour of day."""
    return (
        quakes.groupBy(*calendar(_time(quakes)))
        .agg(_count("event_count"), _avg("magnitude", "avg_magnitude"), _energy())
        .orderBy("day_idx", "hour_of_day")
    )


def pager(quakes):
    """Alert level by tsunami flag."""
    return (
        quakes.groupBy("alert_level", "tsunami_flag")
        .agg(
            _count("event_count"), _avg("magnitude", "avg_magnitude"), _max_magnitude(),
            F.sum("felt_reports").alias("total_felt"),
        )
        .orderBy("alert_level", "tsunami_flag")
    )


def kpis(quakes):
    """One row of headline figures; zeros for an empty slice."""
    return quakes.agg(
        _count("events"),
        F.coalesce(F.max("magnitude"), F.lit(0.0)).alias("peak_magnitude"),
        F.coalesce(F.avg("depth_km"), F.lit(0.0)).alias("avg_depth_km"),
        F.coalesce(F.sum("tsunami_flag"), F.lit(0)).alias("tsunami_alerts"),
    )


def corpus(quakes):
    return quakes.agg(_count("events"), _max_magnitude())


def _per_level(quakes, measures):
    """One row per alert level, present or not, from a single one-row aggregate."""
    names = [name for name, _ in measures]
    one = quakes.agg(
        *[
            F.count_if((F.col("alert_level") == level) & condition).alias(f"{level}_{name}")
            for level in ALERT_LEVELS
            for name, condition in measures
        ]
    )
    rows = F.array(*[
        F.struct(
            F.lit(level).alias("alert_level"), F.lit(place).alias("level_order"),
            *[F.col(f"{level}_{name}").alias(name) for name in names],
        )
        for place, level in enumerate(ALERT_LEVELS)
    ])
    return one.select(F.inline(rows)).select("alert_level", *names)


def alert_counts(quakes):
    """Events per alert level in display order, absent levels as 0."""
    return _per_level(quakes, [("event_count", F.lit(True))])


def alert_tsunami_pivot(quakes):
    """Events per alert level without and with a tsunami flag, absent cells as 0."""
    flag = F.col("tsunami_flag")
    return _per_level(quakes, [("no_tsunami", flag == 0), ("tsunami", flag == 1)])


def hour_day_grid(quakes):
    """24 rows of seven day columns (``mon`` .. ``sun``), all 168 cells present."""
    days = [name[:3].lower() for name in DAY_NAMES]
    day_idx, _, hour = calendar(_time(quakes))
    cells = (
        quakes.select(hour, day_idx).groupBy("hour_of_day")
        .pivot("day_idx", list(range(7))).count()
    )
    hours = quakes.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    return (
        hours.join(cells, "hour_of_day", "left")
        .na.fill(0)
        .select("hour_of_day", *[F.col(str(i)).alias(day) for i, day in enumerate(days)])
        .orderBy("hour_of_day")
    )


def day_hour_grid(quakes):
    """The same counts day-major: seven rows of 24 hour columns (``h00`` .. ``h23``)."""
    day_idx, name, hour = calendar(_time(quakes))
    return (
        quakes.select(day_idx, name, hour)
        .groupBy("day_idx", "day_of_week").pivot("hour_of_day", list(range(24))).count()
        .na.fill(0)
        .select("day_idx", "day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
        .orderBy("day_idx")
    )


def _grid_cells(grid):
    days = [c for c in grid.columns if c != "hour_of_day"]
    return grid.select(
        "hour_of_day",
        F.posexplode(F.array(*[F.col(d) for d in days])).alias("day_idx", "event_count"),
    )


def hour_totals(quakes):
    """Events per hour of day and their mean over the 24 hours."""
    grid = hour_day_grid(quakes)
    days = [c for c in grid.columns if c != "hour_of_day"]
    total = sum((F.col(d) for d in days[1:]), F.col(days[0]))
    totals = grid.select("hour_of_day", total.alias("total_events"))
    return totals.withColumn("mean_hourly", totals.agg(F.avg("total_events")).scalar())


def hot_cells(quakes, factor=HOT_CELL):
    """All 168 cells, flagged where they exceed ``factor`` times the mean cell."""
    cells = _grid_cells(hour_day_grid(quakes))
    mean = cells.agg(F.avg("event_count")).scalar()
    return cells.withColumn("hot", F.col("event_count") > mean * F.lit(factor))


def regions(quakes):
    return quakes.select("region").distinct().orderBy("region")


def region_hourly(quakes):
    """Events and mean magnitude by region and hour."""
    return quakes.groupBy(
        "region", bucket(_time(quakes), "hour").alias("hour_window")
    ).agg(_count("event_count"), _avg("magnitude", "avg_magnitude"))


def region_alerts(quakes):
    """Peak magnitude and events per alert level, by region."""
    return quakes.groupBy("region").agg(
        _max_magnitude(),
        *[F.count_if(F.col("alert_level") == lv).alias(f"{lv}_count") for lv in ALERT_LEVELS],
    )
