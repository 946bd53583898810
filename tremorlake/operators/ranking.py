"""Top lists and the stratified sample."""

from pyspark.sql import functions as F

from ..functions.measures import place_tail
from .filters import STRATUM_SPLIT, known_region, with_stratum
from .rollups import regional_scorecard

SAMPLE_SIZE = 1200  # fixed values
SAMPLE_SEED = 42
TOP_PLACES = 6
TOP_REGIONS = 8


def top_places(quakes, k=TOP_PLACES):
    """The largest event of each place, largest ``k`` of them."""
    best = F.struct("magnitude", "event_id", "longitude", "latitude")
    # Ties go to the smallest id; ids are text, so the largest magnitude is found first.
    order = F.struct(-F.col("magnitude"), F.col("event_id"))
    return (
        quakes.groupBy("place").agg(F.min_by(best, order).alias("best"))
        .select("place", "best.*")
        .orderBy(F.desc("magnitude"), "event_id").limit(k)
        .withColumn("label", place_tail("place"))
    )


def top_regions(quakes, k=TOP_REGIONS):
    """The busiest named regions."""
    return known_region(regional_scorecard(quakes)).orderBy(
        F.desc("event_count"), "region"
    ).limit(k)


def sample_rank(seed=SAMPLE_SEED, column="event_id"):
    """A fixed pseudo-random order of events."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column)))


def strata_sample(quakes, split=STRATUM_SPLIT, n=SAMPLE_SIZE, seed=SAMPLE_SEED):
    """All major events and ``n`` moderate ones, in time order.

    The sample is the first ``n`` by a hash of the id: exactly ``n``, and the same ones on
    every run and partitioning. Rows are first cut at a hash that leaves about four times
    ``n`` of them, so the ordered limit does not get ``n`` rows from every task; if the cut
    should leave fewer than ``n``, all are ordered.
    """
    rows = with_stratum(quakes, split)
    moderate = rows.filter(F.col("stratum") == "moderate")
    place = F.conv(F.substring(sample_rank(seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    total = moderate.agg(F.count(F.lit(1))).scalar()
    low = place * total <= F.lit(4.0 * n)
    enough = moderate.filter(low).agg(F.count(F.lit(1)) >= n).scalar()
    chosen = moderate.filter(low | ~enough).orderBy(sample_rank(seed), "event_id").limit(n)
    return rows.filter(F.col("stratum") == "major").unionByName(chosen).orderBy(
        "epoch_millis", "event_id"
    )
