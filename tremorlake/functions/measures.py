"""Physical measures and classes of one event, as columns."""

from pyspark.sql import functions as F

# Energy law log10 E = 4.8 + 1.5 M, in joules.
ENERGY_INTERCEPT = 4.8
ENERGY_SLOPE = 1.5

# Depth limits in km and the labels on either side.
SHALLOW_BELOW = 35.0
INTERMEDIATE_UP_TO = 150.0
DEPTH_SHORT = (
    "Shallow (0-35 km)",
    "Intermediate (35-150 km)",
    "Deep (150-700 km)",
)
DEPTH_LONG = (
    "Shallow (0-35 km) - High Crustal Risk",
    "Intermediate (35-150 km) - Subduction Zone",
    "Deep (150-700 km) - Mantle Transition",
)

# Display sizes (intercept, factor, origin, exponent, low, high).
MAP_SIZE = (12.0, 8.0, 4.8, 1.6, 12.0, 220.0)
TIMELINE_SIZE = (35.0, 25.0, 6.2, 1.4, 35.0, 180.0)
SCATTER_SIZE = (0.0, 18.0, 4.5, 1.4, 18.0, 260.0)

JOULES_PER_PETAJOULE = 1e15
BYTES_PER_MB = 1024 * 1024


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def seismic_energy(magnitude):
    """Radiated energy in joules; 0.0 where it cannot be expressed."""
    joules = F.pow(
        F.lit(10.0),
        F.lit(ENERGY_INTERCEPT) + F.lit(ENERGY_SLOPE) * _col(magnitude).try_cast("double"),
    )
    return F.when(joules < F.lit(float("inf")), joules).otherwise(F.lit(0.0))


def energy_sql(magnitude):
    """``seismic_energy`` as SQL text."""
    joules = f"pow(10D, {ENERGY_INTERCEPT}D + {ENERGY_SLOPE}D * try_cast({magnitude} AS DOUBLE))"
    return f"CASE WHEN {joules} < double('Infinity') THEN {joules} ELSE 0D END"


def depth_sql(depth_km, labels=DEPTH_SHORT):
    """``depth_class`` as SQL text."""
    shallow, middle, deep = labels
    return (
        f"CASE WHEN {depth_km} < {SHALLOW_BELOW}D THEN '{shallow}' "
        f"WHEN {depth_km} <= {INTERMEDIATE_UP_TO}D THEN '{middle}' ELSE '{deep}' END"
    )


def depth_class(depth_km, labels=DEPTH_SHORT):
    """One of three depth layers; an unknown depth falls to the last one."""
    depth = _col(depth_km)
    shallow, middle, deep = labels
    return (
        F.when(depth < SHALLOW_BELOW, F.lit(shallow))
        .when(depth <= INTERMEDIATE_UP_TO, F.lit(middle))
        .otherwise(F.lit(deep))
    )


def severity_band(magnitude):
    m = _col(magnitude)
    return (
        F.when(m < 3.0, "minor").when(m < 4.5, "moderate").when(m < 6.0, "strong")
        .when(m >= 6.0, "major")
    )


def alert_band(magnitude):
    """Shaded band of the event timeline: 5-6, 6-7 or 7-9, else null."""
    m = _col(magnitude)
    return (
        F.when((m >= 5.0) & (m < 6.0), "5-6").when((m >= 6.0) & (m < 7.0), "6-7")
        .when((m >= 7.0) & (m <= 9.0), "7-9")
    )


def display_size(magnitude, spec=MAP_SIZE):
    """``clip(a + b * (M - m0) ** p, low, high)``; below the origin it is ``low``."""
    a, b, origin, power, low, high = spec
    m = _col(magnitude)
    size = F.lit(a) + F.lit(b) * F.pow(m - F.lit(origin), F.lit(power))
    return F.when(m < origin, F.lit(low)).otherwise(
        F.greatest(F.least(size, F.lit(high)), F.lit(low))
    )


def petajoules(joules):
    return _col(joules) / F.lit(JOULES_PER_PETAJOULE)


def megabytes(size_bytes, digits=2):
    return F.round(_col(size_bytes) / F.lit(BYTES_PER_MB), digits)


def place_tail(place):
    """Last comma-separated part of a place description."""
    return F.trim(F.element_at(F.split(_col(place), ","), -1))
