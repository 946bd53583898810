from pyspark.sql import functions as F

from helpers import feature, feature_frame
from tremorlake.operators import cleansing
from tremorlake.sources import readers, writers

def now():
    return F.lit("2024-09-07 10:00:00").cast("timestamp")


def test_dedup_keeps_latest_update(spark):
    rows = [
        feature("a", mag=1.0, updated=1), feature("a", mag=2.0, updated=3),
        feature("a", mag=3.0, updated=2), feature("b", mag=4.0), feature("b", mag=4.0),
        feature("", mag=5.0), feature(None, mag=6.0),
    ]
    got = {r.id: r.properties.mag for r in cleansing.dedup(feature_frame(spark, rows)).collect()}
    assert got == {"a": 2.0, "b": 4.0}


def test_dedup_of_a_hot_id_combines_before_the_shuffle(spark):
    """A third of all rows are copies of one event."""
    ids = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), "id")).alias("id"),
        F.struct(F.lit(3.0).alias("mag"), F.col("id").alias("updated")).alias("properties"),
        F.lit(1).alias("geometry"),
    )
    out = cleansing.dedup(ids)
    assert out.count() == 6001
    assert out.filter("id = 'hot'").first().properties.updated == 8997
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_null_magnitude_does_not_hide_a_good_copy(spark):
    rows = [feature("a", mag=None, updated=9), feature("a", mag=2.0, updated=1)]
    assert cleansing.process(feature_frame(spark, rows)).first().magnitude == 2.0


def test_second_landing_is_empty(spark):
    batch = feature_frame(spark, [feature("mock_test_quake_001")])
    nothing = spark.createDataFrame([], "id string, last_seen timestamp")
    new, seen, audit = cleansing.dedup_incremental(batch, nothing, now())
    assert new.count() == 1 and tuple(audit.first()) == (1, 1, 1)
    again, seen, audit = cleansing.dedup_incremental(batch, seen, now())
    assert again.count() == 0 and tuple(audit.first()) == (1, 0, 1)


def test_trim_seen_with_ties(spark):
    """All ids of a backfill share one instant; exactly the newest n stay."""
    seen = spark.range(5000).select(
        F.concat(F.lit("q"), "id").alias("id"),
        F.timestamp_millis(F.when(F.col("id") < 100, F.col("id") + 10).otherwise(F.lit(5))).alias(
            "last_seen"
        ),
    )
    kept = cleansing.trim_seen(seen, 700, slices=16)
    rows = kept.collect()
    assert len(rows) == 700 and len({r.id for r in rows}) == 700
    assert kept.filter(F.unix_millis("last_seen") > 5).count() == 100
    assert sorted(rows) == sorted(cleansing.trim_seen(seen, 700, slices=3).collect())
    assert cleansing.trim_seen(seen, 9999).count() == 5000


def test_flatten_defaults(spark):
    rows = [
        feature("a", place=None, point=(1.0,), alert="", magType=""),
        feature("b", point=(), felt=3, alert="red", tsunami=1, sig=7, magType="ml"),
    ]
    a, b = cleansing.flatten(feature_frame(spark, rows)).orderBy("event_id").collect()
    assert (a.place, a.region, a.longitude, a.latitude, a.depth_km) == (
        None, "GLOBAL_OTHER", 1.0, 0.0, 0.0)
    assert (a.felt_reports, a.alert_level, a.tsunami_flag, a.significance, a.magnitude_type) == (
        0, "none", 0, 0, "unknown")
    assert (b.felt_reports, b.alert_level, b.tsunami_flag, b.significance, b.magnitude_type) == (
        3, "red", 1, 7, "ml")
    assert b.region == "CALIFORNIA" and b.dt == "2024-09-07"
    w = cleansing.flatten(feature_frame(spark, rows), "warehouse").orderBy("event_id").first()
    assert (w.latitude, w.alert_level, w.region) == (None, "", "GLOBAL_OTHER")


def test_quarantine(spark):
    rows = [feature("a"), feature("b", time=None), feature("c", point=None), feature("")]
    good, bad = cleansing.split_corrupt(feature_frame(spark, rows))
    assert [r.id for r in good.collect()] == ["a"]
    assert {r.id: r.reason for r in bad.collect()} == {
        "b": "no time", "c": "no geometry", "": "no id"}


def test_malformed_files(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "good.json").write_text(
        '{"type": "FeatureCollection",\n "features": [\n'
        '{"id": "a", "properties": {"mag": 1.5, "time": 1, "tz": null}, '
        '"geometry": {"type": "Point", "coordinates": [1, 2, 3]}},\n'
        '{"id": "b", "properties": {"mag": "bad", "time": 2}, "geometry": null}]}'
    )
    (folder / "broken.json").write_text('{"features": [{"id": "c", ')
    found = readers.read_feature_collections(spark, str(folder))
    assert {r.id: r.properties.mag for r in found.collect()} == {"a": 1.5, "b": None}
    broken = readers.broken_documents(spark, str(folder)).collect()
    assert [r.source_file.endswith("broken.json") for r in broken] == [True]

    (tmp_path / "x.jsonl").write_text(
        '{"id": "a", "properties": {"mag": 1.0, "time": 5}, "geometry": {"coordinates": [1]}}\n'
        '{"id": \n'
    )
    lines = readers.read_features_ndjson(spark, str(tmp_path), "*.jsonl")
    good, bad = cleansing.split_corrupt(lines)
    assert [r.id for r in good.collect()] == ["a"]
    assert [(r.reason, r._corrupt_record) for r in bad.collect()] == [("no id", '{"id": ')]


def test_first_file_and_position_break_ties(spark, tmp_path):
    path = str(tmp_path / "landed")
    for mag, hour in ((1.0, "05"), (2.0, "06")):
        rows = feature_frame(spark, [feature("a", mag=mag, updated=7)])
        writers.land_features(rows, path, f"2024-02-01 {hour}:00:00")
    found = cleansing.dedup(readers.read_feature_collections(spark, path)).collect()
    assert [r.properties.mag for r in found] == [1.0]


def test_audit(spark):
    rows = feature_frame(spark, [feature("a"), feature("b"), feature("a")])
    first = rows.withColumn("batch", F.lit("1"))
    second = feature_frame(spark, [feature("a"), feature("c")]).withColumn("batch", F.lit("2"))
    third = feature_frame(spark, [feature("c")]).withColumn("batch", F.lit("3"))
    audit = cleansing.batch_audit(first.unionByName(second).unionByName(third), "batch")
    assert {tuple(r) for r in audit.collect()} == {
        ("1", 3, 2, 2), ("2", 2, 2, 1), ("3", 1, 1, 0)}
