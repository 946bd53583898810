"""Dedup, cleansing, flattening, audit."""

from pyspark.sql import functions as F

from ..functions.regions import WAREHOUSE12
from ..operators import cleansing, seen
from ..plans import warehouse
from ..plans.batch import run_batch
from ..session import workspace
from ..sources import readers, writers
from ..sources.events_view import features, quakes
from .registry import oracle, query
from .expressions import region_sql


def set_property(rows, **columns):
    p = F.col("properties")
    for name, value in columns.items():
        p = p.withField(name, value)
    return rows.withColumn("properties", p)


def copies(rows):
    """One to three copies of each event, each later one updated later; ``sig`` counts them."""
    which = F.sequence(F.lit(0), F.pmod(F.col("properties.time"), F.lit(3)).cast("int"))
    many = rows.select("*", F.explode(which).alias("copy"))
    return set_property(
        many, updated=F.col("properties.time") + F.col("copy") * 1000, sig=F.col("copy")
    ).drop("copy")


@query("b1_dedup", oracle("""
SELECT id, mag, CAST(time % 3 AS INTEGER) AS copy, time + time % 3 * 1000 AS updated FROM raw"""))
def dedup(spark, sf_dir):
    return cleansing.dedup(copies(features(spark, sf_dir))).select(
        "id", F.col("properties.mag").alias("mag"), F.col("properties.sig").alias("copy"),
        F.col("properties.updated").alias("updated"),
    )


def polls(rows):
    """A sliding feed: each event comes with the poll of its six days and with the next."""
    first = F.floor((F.dayofmonth(F.timestamp_millis("properties.time")) - 1) / 6).cast("int")
    return rows.select("*", F.explode(F.array(first, first + 1)).alias("poll"))


_POLLS = """polled AS (
  SELECT id, time, p + again AS poll, p FROM (
    SELECT id, time, CAST((day(make_timestamp(time * 1000)) - 1) // 6 AS INTEGER) AS p FROM raw),
    range(2) r(again))"""


def _incremental(spark, sf_dir):
    """Everything the feed ever delivered, against what its first three polls brought."""
    delivered = polls(features(spark, sf_dir))
    seen = delivered.filter(F.col("poll") <= 2).groupBy("id").agg(
        F.max(F.timestamp_millis("properties.time")).alias("last_seen")
    )
    return cleansing.dedup_incremental(delivered, seen, F.lit("2024-02-01").cast("timestamp"))


@query("b2_incremental_new", oracle("SELECT DISTINCT id, time FROM polled WHERE p >= 3", _POLLS))
def incremental(spark, sf_dir):
    new, _, _ = _incremental(spark, sf_dir)
    return new.select("id", F.col("properties.time").alias("time"))


@query("b2_incremental_audit", oracle("""
SELECT count(*) AS polled, count(DISTINCT id) FILTER (p >= 3) AS new, count(DISTINCT id) AS seen
FROM polled""", _POLLS))
def incremental_audit(spark, sf_dir):
    return _incremental(spark, sf_dir)[2]


@query("b2_seen_polls", oracle("""
SELECT poll, count(*) AS polled, count(*) FILTER (again = 0) AS new,
       (SELECT count(DISTINCT id) FROM thrice b WHERE b.poll <= a.poll) AS seen
FROM thrice a GROUP BY poll""", _POLLS, """thrice AS (
  SELECT id, poll, CAST(poll - p AS INTEGER) AS again FROM polled WHERE poll <= 2)"""))
def seen_polls(spark, sf_dir):
    """Three polls against the stored ids: each reads and writes only the buckets it touches."""
    store, delivered = workspace(spark, "b2-seen"), polls(features(spark, sf_dir))
    audits = None
    for k in range(3):
        _, row = seen.poll(delivered.filter(F.col("poll") == k).drop("poll"), store, k,
                           F.lit(f"2024-02-0{k + 1}").cast("timestamp"))
        row = row.select(F.lit(k).cast("bigint").alias("poll"), "*")
        audits = row if audits is None else audits.unionByName(row)
    return audits


@query("b3_trim_seen", oracle(
    "SELECT id, time FROM raw ORDER BY time DESC LIMIT 5000"))
def trim_seen(spark, sf_dir):
    seen = features(spark, sf_dir).select(
        "id", F.timestamp_millis("properties.time").alias("last_seen")
    )
    return cleansing.trim_seen(seen, 5000).select("id", F.unix_millis("last_seen").alias("time"))


@query("b4_drop_incomplete", oracle("""
SELECT id, mag FROM raw WHERE event_type <> 'signup' AND NOT (time % 7 IN (0, 1))"""))
def drop_incomplete(spark, sf_dir):
    rows = features(spark, sf_dir)
    millis = F.col("properties.time")
    rows = rows.withColumn(
        "id", F.when(millis % 7 == 0, None).when(millis % 7 == 1, "").otherwise(F.col("id"))
    )
    no_mag = F.coalesce(F.col("properties.alert"), F.lit("")) == "yellow"  # signups
    rows = set_property(rows, mag=F.when(~no_mag, F.col("properties.mag")))
    return cleansing.drop_incomplete(rows).select("id", F.col("properties.mag").alias("mag"))


def _quality(name, least):
    sql = oracle(f"""
SELECT id AS event_id, mag AS magnitude, depth_km FROM raw
WHERE mag10 >= {round(least * 10)} AND time % 4 <> 2""")

    @query(name, sql)
    def run(spark, sf_dir):
        """Every fourth event or so has no depth."""
        rows = cleansing.flatten(features(spark, sf_dir), "cleansed").withColumn(
            "depth_km", F.when(F.col("epoch_millis") % 4 != 2, F.col("depth_km"))
        )
        return cleansing.quality_filter(rows, least).select("event_id", "magnitude", "depth_km")


_quality("b5_quality_filter", 1.0)
_quality("b5_quality_filter_strict", 2.5)

_ROW = """event_id, magnitude, place, region, strftime(event_time, '%Y-%m-%d %H:%M:%S.%g') AS event_time,
       epoch_millis, longitude, latitude, depth_km, felt_reports, alert_level, tsunami_flag,
       significance, magnitude_type, round(log10(energy), 9) AS log10_joules, dt"""


def _comparable(rows):
    return rows.withColumn(
        "log10_joules", F.round(F.log10("seismic_energy_joules"), 9)
    ).drop("seismic_energy_joules").withColumn(
        "event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSS")
    )


@query("b6a_flatten", oracle(f"SELECT {_ROW} FROM quakes"))
def flatten(spark, sf_dir):
    return _comparable(cleansing.flatten(features(spark, sf_dir)))


@query("b6b_flatten_sql", oracle(
    f"SELECT {_ROW} FROM (SELECT * EXCLUDE (region) FROM quakes) JOIN ({region_sql(WAREHOUSE12)}) USING (event_id)"))
def flatten_sql(spark, sf_dir):
    warehouse.register(quakes(spark, sf_dir), features(spark, sf_dir))
    return _comparable(spark.sql(warehouse.ETL))


@query("b6b_flatten_warehouse", oracle(
    f"SELECT {_ROW} FROM (SELECT * EXCLUDE (region) FROM quakes) JOIN ({region_sql(WAREHOUSE12)}) USING (event_id)"))
def flatten_warehouse(spark, sf_dir):
    return _comparable(cleansing.flatten(features(spark, sf_dir), "warehouse"))


@query("b6c_flatten_maps", oracle("""
SELECT id AS event_id, mag AS magnitude, place, time AS epoch_millis, longitude, latitude, depth_km,
       felt AS felt_reports, alert AS alert_level, tsunami AS tsunami_flag FROM raw"""))
def flatten_maps(spark, sf_dir):
    untyped = features(spark, sf_dir).select(
        "id",
        *[F.from_json(F.to_json(c), "map<string,string>").alias(c) for c in ("properties", "geometry")],
    )
    return cleansing.flatten_maps(untyped)


@query("b6c_flatten_map_lines", oracle("""
SELECT id AS event_id, mag AS magnitude, place, time AS epoch_millis, longitude, latitude, depth_km,
       felt AS felt_reports, alert AS alert_level, tsunami AS tsunami_flag FROM raw"""))
def flatten_map_lines(spark, sf_dir):
    """Landed lines, read untyped."""
    path = workspace(spark, "b6c")
    writers.land_features(features(spark, sf_dir), path, "2024-02-01 05:06:07", "lines")
    return cleansing.flatten_maps(readers.read_feature_maps(spark, path))


@query("b7_defaults", oracle("""
SELECT id AS event_id, CASE WHEN time % 4 >= 1 THEN longitude ELSE 0 END AS longitude,
       CASE WHEN time % 4 >= 2 THEN latitude ELSE 0 END AS latitude,
       CASE WHEN time % 4 >= 3 THEN depth_km ELSE 0 END AS depth_km,
       coalesce(felt, 0) AS felt_reports, 'none' AS alert_level, 0 AS tsunami_flag,
       0 AS significance, 'unknown' AS magnitude_type, 'GLOBAL_OTHER' AS region
FROM raw"""))
def defaults(spark, sf_dir):
    """Texts are empty or null, whole numbers null, coordinate arrays too short."""
    millis = F.col("properties.time")
    gone = F.when(millis % 2 == 0, "")
    rows = features(spark, sf_dir).withColumn(
        "geometry",
        F.col("geometry").withField(
            "coordinates", F.slice("geometry.coordinates", F.lit(1), (millis % 4).cast("int"))
        ),
    )
    nothing = F.lit(None).cast("int")
    rows = set_property(rows, alert=gone, magType=gone, place=gone, tsunami=nothing, sig=nothing)
    return cleansing.flatten(rows).select(
        "event_id", "longitude", "latitude", "depth_km", "felt_reports", "alert_level",
        "tsunami_flag", "significance", "magnitude_type", "region",
    )


@query("b8_malformed_lines", oracle("""
SELECT CASE WHEN time % 5 = 0 THEN 'no id' WHEN time % 5 = 1 THEN 'no time'
            WHEN time % 5 = 2 THEN 'no geometry' ELSE 'usable' END AS outcome,
       count(*) AS features, count(CASE WHEN time % 5 = 4 THEN mag END) AS magnitudes
FROM raw WHERE time % 5 >= 3 GROUP BY 1
UNION ALL
SELECT CASE time % 5 WHEN 0 THEN 'no id' WHEN 1 THEN 'no time' ELSE 'no geometry' END, count(*),
       count(CASE WHEN time % 5 > 0 THEN mag END)
FROM raw WHERE time % 5 < 3 GROUP BY 1"""))
def malformed(spark, sf_dir):
    """Lines as text: cut off early, without a time, without geometry, with a wrongly typed
    magnitude, or sound."""
    path = workspace(spark, "b8")
    millis = F.col("properties.time")
    kind = millis % 5
    rows = features(spark, sf_dir).withColumn("kind", kind)
    rows = set_property(rows, time=F.when(F.col("kind") != 1, millis))
    rows = rows.withColumn("geometry", F.when(F.col("kind") != 2, F.col("geometry")))
    line = F.to_json(F.struct("id", "properties", "geometry"))
    line = (
        F.when(F.col("kind") == 0, F.substring(line, 1, 8))
        .when(F.col("kind") == 3, F.regexp_replace(line, r'"mag":[0-9.]+', '"mag":"bad"'))
        .otherwise(line)
    )
    rows.select(line.alias("value")).write.text(path)
    good, bad = cleansing.split_corrupt(
        readers.read_features_ndjson(spark, path, "*")
    )
    outcome = good.select(F.lit("usable").alias("outcome"), "properties").unionByName(
        bad.select(F.col("reason").alias("outcome"), "properties")
    )
    return outcome.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("features"), F.count("properties.mag").alias("magnitudes")
    )


@query("b9_batch_audit", oracle("""
SELECT CAST(poll AS INTEGER) AS poll, count(*) AS polled, count(DISTINCT id) AS distinct_ids,
       count(DISTINCT id) FILTER (poll = p) AS new
FROM polled GROUP BY poll""", _POLLS))
def audit(spark, sf_dir):
    return cleansing.batch_audit(polls(features(spark, sf_dir)), "poll")


@query("b9_batch_audit_by_ingestion", oracle("""
SELECT ingested_at, features AS polled, features AS distinct_ids, new, features AS batch_count
FROM (SELECT '2024-02-01T05:06:07.000Z' AS ingested_at, count(*) AS features, count(*) AS new FROM raw
      UNION ALL SELECT '2024-02-01T06:00:00.000Z', count(*), 0 FROM raw WHERE time % 2 = 0)"""))
def audit_by_ingestion(spark, sf_dir):
    """Two landed deliveries: one row per ingestion, its documents' counts added up."""
    path = workspace(spark, "b9")
    rows = features(spark, sf_dir)
    writers.land_features(rows, path, "2024-02-01 05:06:07")
    writers.land_features(
        rows.filter(F.col("properties.time") % 2 == 0), path, "2024-02-01 06:00:00")
    counts = readers.landed_documents(spark, path).groupBy("ingested_at").agg(
        F.sum("batch_count").alias("batch_count"))
    return cleansing.batch_audit(readers.read_feature_collections(spark, path)).join(
        counts, "ingested_at")


@query("b8_batch_quarantine", oracle("""
SELECT 'no time' AS reason, count(*) AS features FROM raw WHERE time % 5 = 1
UNION ALL SELECT 'no geometry', count(*) FROM raw WHERE time % 5 = 2
UNION ALL SELECT 'processed', count(*) FROM raw WHERE time % 5 NOT IN (1, 2)
UNION ALL SELECT 'broken document', 1"""))
def batch_quarantine(spark, sf_dir):
    """The whole batch run over landed documents: what it leaves out is written with a reason."""
    root = workspace(spark, "b8-batch")
    kind = F.col("properties.time") % 5
    rows = features(spark, sf_dir).withColumn("kind", kind)
    rows = set_property(rows, time=F.when(F.col("kind") != 1, F.col("properties.time")))
    rows = rows.withColumn("geometry", F.when(F.col("kind") != 2, F.col("geometry")))
    writers.land_features(rows.drop("kind"), f"{root}/landed", "2024-02-01 05:06:07")
    spark.createDataFrame([('{"features": [{"id": "cut',)], "value string").coalesce(1) \
        .write.text(f"{root}/landed/broken")
    path = f"{root}/landed"
    quakes_ = run_batch(
        spark, readers.read_feature_collections(spark, path, "*"), f"{root}/processed",
        f"{root}/cube", f"{root}/rollups", f"{root}/serving", f"{root}/quarantine",
        f"{root}/audit", readers.broken_documents(spark, path, "*"))
    left = spark.read.schema("reason string").json(f"{root}/quarantine/features")
    broken = spark.read.schema("document string").json(f"{root}/quarantine/documents")
    count = F.count(F.lit(1)).alias("features")
    return left.groupBy("reason").agg(count).unionByName(
        quakes_.agg(F.lit("processed").alias("reason"), count)
    ).unionByName(broken.agg(F.lit("broken document").alias("reason"), count))
