"""From raw features to the processed table: cleansing, dedup, flattening, audit."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.measures import energy_sql
from ..functions.regions import FULL17, WAREHOUSE12, region_sql
from ..schemas import CORRUPT

SEEN_LIMIT = 50_000  # fixed value

NO_ALERT = "none"
NO_TYPE = "unknown"


def has_id(column="id"):
    return F.coalesce(F.length(F.col(column)) > 0, F.lit(False))


def drop_incomplete(features):
    """Drop features without an id or a magnitude."""
    return features.filter(has_id() & F.col("properties.mag").isNotNull())


def split_corrupt(features):
    """(usable features, quarantined features with a reason).

    A wrongly typed field nulls only itself; a feature is quarantined when its id, time or
    geometry cannot be read.
    """
    reason = (
        F.when(~has_id(), "no id")
        .when(F.col("properties.time").isNull(), "no time")
        .when(F.col("geometry").isNull(), "no geometry")
    )
    marked = features.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).drop("reason", CORRUPT)
    return good, marked.filter(F.col("reason").isNotNull())


def _order_of_copies(features):
    """Smallest is the copy to keep: latest update, then first file and position."""
    keys = [F.coalesce(-F.col("properties.updated"), F.lit(2**63 - 1)).alias("age")]
    keys += [F.col(c) for c in ("source_file", "position") if c in features.columns]
    # Copies without any provenance still need a definite winner.
    keys += [F.xxhash64("properties", "geometry").alias("content")]
    return F.struct(*keys)


def dedup(features):
    """One feature per id, the latest update; features without an id are dropped.

    An aggregate, not a ranking window: copies of one id meet in the map-side combine, so
    an id that fills a third of the input costs each task one row in the shuffle.
    """
    payload = F.struct(*[c for c in features.columns if c != "id"])
    best = features.filter(has_id()).select("id", payload.alias("kept"), _order_of_copies(features).alias("ord"))
    return best.groupBy("id").agg(F.min_by("kept", "ord").alias("kept")).select("id", "kept.*")


def dedup_incremental(features, seen, batch_time):
    """Features whose id was not seen before, the grown seen table and an audit row.

    ``seen`` has one row per id: ``id``, ``last_seen``. ``batch_time`` is a column.
    """
    known = seen.select("id", F.lit(True).alias("known"))
    # One dedup and one join serve the new features and the audit.
    marked = dedup(features).join(known, "id", "left")
    new = marked.filter(F.col("known").isNull()).drop("known")
    grown = seen.select("id", "last_seen").unionByName(
        new.select("id", batch_time.cast("timestamp").alias("last_seen"))
    )
    added = marked.agg(F.count_if(F.col("known").isNull())).scalar()
    before = seen.agg(F.count(F.lit(1))).scalar()
    audit = features.agg(
        F.count(F.lit(1)).alias("polled"), added.alias("new"), (before + added).alias("seen")
    )
    return new, grown, audit


def trim_seen(seen, n=SEEN_LIMIT, slices=None):
    """The ``n`` most recently seen ids (of one instant the largest ids).

    A plain ordered limit would let every task send ``n`` rows to one task. The table is
    first cut into ordered slices and only the newest ones that cover ``n`` rows are sorted.
    """
    from ..plans.slices import newest

    return newest(seen, F.unix_millis("last_seen"), "id", n, slices)


def quality_filter(quakes, min_magnitude=1.0):
    """Complete rows of at least ``min_magnitude``."""
    return quakes.filter(
        has_id("event_id")
        & F.col("depth_km").isNotNull()
        & (F.col("magnitude") >= F.lit(float(min_magnitude)))
    )


POINT = ("longitude", "latitude", "depth_km")  # order of a coordinate array
NESTED_POINT = tuple(f"get(geometry.coordinates, {i})" for i in range(3))
MAP_POINT = tuple(f"get(from_json(geometry['coordinates'], 'array<double>'), {i})" for i in range(3))


def cleansed_columns(prop="properties.{}".format, point=NESTED_POINT):
    """The ten columns of the cleansing step, as found, as SQL texts."""
    return [
        "id AS event_id",
        f"{prop('mag')} AS magnitude",
        f"{prop('place')} AS place",
        f"{prop('time')} AS epoch_millis",
        *[f"{value} AS {name}" for name, value in zip(POINT, point)],
        f"{prop('felt')} AS felt_reports",
        f"{prop('alert')} AS alert_level",
        f"{prop('tsunami')} AS tsunami_flag",
    ]


def processed_columns(prop="properties.{}".format, point=NESTED_POINT, full=True):
    """The sixteen processed columns as SQL texts.

    ``prop`` gives the text of a property by name, ``point`` the three coordinates.
    ``full`` defaults missing coordinates and empty texts and uses all seventeen region
    rules; otherwise coordinates stay null and twelve rules apply.
    """
    def text(name, default):
        value = prop(name)
        return f"coalesce(nullif({value}, ''), '{default}')" if full else f"coalesce({value}, '{default}')"

    instant = f"timestamp_millis({prop('time')})"
    return [
        "id AS event_id",
        f"{prop('mag')} AS magnitude",
        f"{prop('place')} AS place",
        f"{region_sql(prop('place'), FULL17 if full else WAREHOUSE12)} AS region",
        f"{instant} AS event_time",
        f"{prop('time')} AS epoch_millis",
        *[
            f"coalesce({value}, 0D) AS {name}" if full else f"{value} AS {name}"
            for name, value in zip(POINT, point)
        ],
        f"coalesce({prop('felt')}, 0) AS felt_reports",
        f"{text('alert', NO_ALERT)} AS alert_level",
        f"coalesce({prop('tsunami')}, 0) AS tsunami_flag",
        f"coalesce({prop('sig')}, 0) AS significance",
        f"{text('magType', NO_TYPE)} AS magnitude_type",
        f"{energy_sql(prop('mag'))} AS seismic_energy_joules",
        f"date_format({instant}, 'yyyy-MM-dd') AS dt",
    ]


def flatten(features, flavour="full"):
    """Nested features as flat rows.

    ``full``: the sixteen processed columns, missing values defaulted.
    ``warehouse``: the same columns with the twelve-rule regions; coordinates stay null.
    ``cleansed``: ten columns as found, for the quality filter and the text sink.
    """
    if flavour == "cleansed":
        return features.selectExpr(*cleansed_columns())
    if flavour not in ("full", "warehouse"):
        raise ValueError(f"unknown flavour {flavour!r}")
    return features.selectExpr(*processed_columns(full=flavour == "full"))


def flatten_maps(features):
    """The cleansed columns from untyped features (``properties`` and ``geometry`` as
    string maps): each entry is looked up by name and cast; what cannot be cast is null."""
    kinds = {"mag": "DOUBLE", "time": "BIGINT", "felt": "INT", "tsunami": "INT"}

    def entry(name):
        return f"try_cast(properties['{name}'] AS {kinds.get(name, 'STRING')})"

    return features.selectExpr(*cleansed_columns(entry, MAP_POINT))


def process(features):
    """The whole batch step: quarantine aside, incomplete dropped, one copy, flat.

    What is quarantined is in ``rejected``.
    """
    good, _ = split_corrupt(features)
    return flatten(dedup(drop_incomplete(good)))


def rejected(features):
    """What ``process`` leaves out as unusable: the reason, where it was found, the feature as
    text (a broken line as it stands)."""
    _, bad = split_corrupt(features)
    found = [c for c in ("source_file", "position", "ingested_at") if c in features.columns]
    text = F.to_json(F.struct("id", "properties", "geometry"))
    if CORRUPT in features.columns:
        text = F.coalesce(F.col(CORRUPT), text)
    return bad.select("reason", *found, text.alias("feature"))


def batch_audit(features, batch="ingested_at"):
    """Per batch (one ingestion): features polled, distinct ids, and ids no earlier batch had.

    Copies are merged per id and batch first, so the window sees an id once per batch.
    """
    per_id = features.filter(has_id()).groupBy("id", batch).agg(F.count(F.lit(1)).alias("copies"))
    first = F.min(batch).over(W.partitionBy("id"))
    return (
        per_id.withColumn("first", first)
        .groupBy(batch)
        .agg(
            F.sum("copies").alias("polled"),
            F.count(F.lit(1)).alias("distinct_ids"),
            F.count_if(F.col(batch) == F.col("first")).alias("new"),
        )
    )
