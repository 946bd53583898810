"""The serving table."""

from pyspark.sql import functions as F

from ..operators import serving
from ..plans import warehouse
from ..session import workspace
from ..sources.events_view import quakes
from .registry import oracle, query

_KEY = "region || '#' || lpad(CAST(9223372036854775807 - epoch_millis AS VARCHAR), 19, '0') AS row_key"
_KEYED = f"keyed AS (SELECT *, {_KEY}, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM quakes)"


def _write(spark, sf_dir):
    path = workspace(spark, "serving")
    serving.write_serving(serving.serving_rows(quakes(spark, sf_dir)), path)
    return path


def prepare(spark, sf_dir):
    """The loaded serving table's path: the prepared input that the seeks take."""
    return _write(spark, sf_dir)


def _written(spark, sf_dir, path=None):
    """The serving table at ``path``, or one loaded for this query."""
    return serving.read_serving(spark, path or prepare(spark, sf_dir))


# One row per key: the largest event id.
_UPSERTED = """upserted AS (SELECT * FROM keyed
  QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY event_id DESC) = 1)"""

_FAMILIES = """row_key, region, epoch_millis, event_id, magnitude AS mag, place, depth_km, latitude,
       longitude, iso AS event_time, alert_level AS alert, tsunami_flag AS tsunami,
       felt_reports AS felt, significance AS sig, magnitude_type AS magType"""


@query("a12_serving_load", oracle(f"SELECT {_FAMILIES} FROM upserted", _KEYED, _UPSERTED))
def load(spark, sf_dir):
    rows = serving.read_serving(spark, _write(spark, sf_dir))
    return rows.select("row_key", "region", "epoch_millis", "event.*", "meta.*")


_HOUR = 3_600_000
_HOUR_KEYED = f"""keyed AS (SELECT *, {_KEY}, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso
  FROM (SELECT * REPLACE (epoch_millis // {_HOUR} * {_HOUR} AS epoch_millis) FROM quakes))"""


def _collided(spark, sf_dir):
    """All events of a region and hour share their key."""
    rows = quakes(spark, sf_dir)
    hour = F.col("epoch_millis") - F.pmod("epoch_millis", F.lit(_HOUR))
    path = workspace(spark, "serving-collided")
    serving.write_serving(serving.serving_rows(rows.withColumn("epoch_millis", hour)), path)
    return serving.read_serving(spark, path)


@query("a12_serving_load_collisions",
       oracle(f"SELECT {_FAMILIES} FROM upserted", _HOUR_KEYED, _UPSERTED))
def load_collisions(spark, sf_dir):
    return _collided(spark, sf_dir).select(
        "row_key", "region", "epoch_millis", "event.*", "meta.*")


@query("h1b_seek_collisions", oracle(
    f"SELECT {_FAMILIES} FROM upserted WHERE region = 'CALIFORNIA' ORDER BY row_key LIMIT 10",
    _HOUR_KEYED, _UPSERTED))
def seek_collisions(spark, sf_dir):
    rows = serving.seek(_collided(spark, sf_dir), "CALIFORNIA", 10)
    return rows.select("row_key", "region", "epoch_millis", "event.*", "meta.*")


def _two_loads(spark, sf_dir):
    """All events, then all of them again as restated: one unit more of significance."""
    rows = serving.serving_rows(quakes(spark, sf_dir))
    meta = F.col("meta").withField("sig", F.col("meta.sig") + 1)
    return rows, rows.withColumn("meta", meta)


@query("e9_upsert", oracle(
    "SELECT row_key, max(event_id) AS event_id, max_by(significance + 1, event_id) AS sig "
    "FROM keyed GROUP BY row_key", _KEYED))
def upsert(spark, sf_dir):
    old, new = _two_loads(spark, sf_dir)
    return serving.upsert(old, new).select(
        "row_key", F.col("event.event_id").alias("event_id"), F.col("meta.sig").alias("sig")
    )


def _merged_table(spark, sf_dir):
    """All events in loads of every third, then a tenth of them restated."""
    path, (rows, new) = workspace(spark, "serving-merged"), _two_loads(spark, sf_dir)
    load = F.pmod(F.xxhash64("event.event_id"), F.lit(3))
    for k in range(3):
        serving.upsert_serving(rows.filter(load == k), path, k, part_rows=2000)
    again = new.filter(F.col("event.event_id").endswith("7"))
    serving.upsert_serving(again, path, 3, part_rows=2000)
    return path


# Of a key, the latest load stays: a third by hash comes before it, so only single-event keys are
# the same whatever the hash.
@query("e9_merged_table", oracle("""
SELECT row_key, max(event_id) AS event_id,
       max(significance + CASE WHEN event_id LIKE '%7' THEN 1 ELSE 0 END) AS sig
FROM keyed GROUP BY row_key HAVING count(*) = 1""", _KEYED))
def merged_table(spark, sf_dir):
    rows = serving.served(spark, _merged_table(spark, sf_dir))
    single = serving.serving_rows(quakes(spark, sf_dir)).groupBy("row_key").agg(
        F.count(F.lit(1)).alias("n")).filter("n = 1").select("row_key")
    return rows.join(single, "row_key", "left_semi").select(
        "row_key", F.col("event.event_id").alias("event_id"), F.col("meta.sig").alias("sig"))


@query("e9_load_audit", oracle(
    "SELECT CAST(2 * count(*) AS BIGINT) AS loaded, count(DISTINCT row_key) AS row_keys, "
    "2 * count(*) - count(DISTINCT row_key) AS collisions FROM keyed", _KEYED))
def audit(spark, sf_dir):
    old, new = _two_loads(spark, sf_dir)
    return serving.load_audit(old.unionByName(new))


_LATEST = """SELECT event_id, magnitude, place, depth_km,
       strftime(event_time, '%Y-%m-%d %H:%M:%S.%g') AS event_time, alert_level
FROM quakes WHERE region = 'CALIFORNIA' ORDER BY epoch_millis DESC, event_id LIMIT 10"""


def _time_text(df):
    return df.withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS"))


@query("h1a_latest_scan", oracle(_LATEST))
def latest(spark, sf_dir):
    return _time_text(serving.latest(quakes(spark, sf_dir), "CALIFORNIA"))


@query("h1a_latest_sql", oracle(_LATEST))
def latest_sql(spark, sf_dir):
    warehouse.register(quakes(spark, sf_dir))
    return _time_text(warehouse.latest(spark, "CALIFORNIA"))


@query("h1b_seek", oracle(
    f"SELECT {_FAMILIES} FROM upserted WHERE region = 'CALIFORNIA' ORDER BY row_key LIMIT 10", _KEYED, _UPSERTED))
def seek(spark, sf_dir, path=None):
    rows = serving.seek(_written(spark, sf_dir, path), "CALIFORNIA", 10)
    return rows.select("row_key", "region", "epoch_millis", "event.*", "meta.*")


@query("h1b_seek_listing", oracle(
    "SELECT row_key, 'M ' || printf('%.1f', magnitude) AS magnitude, place, depth_km, "
    "iso AS event_time, alert_level AS alert FROM upserted WHERE region = 'ALASKA' "
    "ORDER BY row_key LIMIT 5", _KEYED, _UPSERTED))
def seek_listing(spark, sf_dir, path=None):
    return serving.seek_table(_written(spark, sf_dir, path), "ALASKA", 5)


@query("h1c_latest_all_regions", oracle("""
SELECT region, row_key, event_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY row_key, event_id) AS rank FROM keyed)
WHERE rank <= 10""", _KEYED))
def latest_all(spark, sf_dir):
    rows = serving.latest_all(serving.serving_rows(quakes(spark, sf_dir)), 10)
    return rows.select("region", "row_key", F.col("event.event_id").alias("event_id"), "rank")


@query("h2_seek_one", oracle(
    "SELECT magnitude AS mag, place, iso AS event_time, alert_level AS alert FROM upserted "
    "WHERE region = 'ALASKA' ORDER BY row_key LIMIT 1", _KEYED, _UPSERTED))
def seek_one(spark, sf_dir, path=None):
    return serving.seek_one(_written(spark, sf_dir, path), "ALASKA")


@query("h2_seek_one_major", oracle(
    "SELECT magnitude AS mag, place, iso AS event_time, alert_level AS alert FROM upserted "
    "WHERE region = 'ALASKA' AND mag10 >= 50 ORDER BY row_key LIMIT 1", _KEYED, _UPSERTED))
def seek_one_major(spark, sf_dir, path=None):
    return serving.seek_one(_written(spark, sf_dir, path), "ALASKA", 5.0)


@query("h6_retention", oracle("""
SELECT row_key, CASE WHEN epoch_millis >= epoch_ms(TIMESTAMP '2024-02-14') - 30 * 86400000::BIGINT
                     THEN magnitude END AS mag, alert_level AS alert
FROM keyed""", _KEYED))
def retention(spark, sf_dir):
    rows = serving.expire_event_family(
        serving.serving_rows(quakes(spark, sf_dir)), "2024-02-14"
    )
    return rows.select("row_key", F.col("event.mag").alias("mag"), F.col("meta.alert").alias("alert"))
