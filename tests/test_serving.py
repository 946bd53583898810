import re

from pyspark.sql import functions as F

from helpers import plan, quake_frame
from tremorlake.operators import serving
from tremorlake.sources import parts


def _load(spark, quakes, tmp_path):
    path = str(tmp_path / "serving")
    serving.write_serving(serving.serving_rows(quakes), path)
    return serving.read_serving(spark, path)


def test_seek_is_newest_first_and_equals_the_scan(spark, quakes, tmp_path):
    table = _load(spark, quakes, tmp_path)
    found = serving.seek(table, "CALIFORNIA", 5).collect()
    times = [r.epoch_millis for r in found]
    assert len(times) == 5 and times == sorted(times, reverse=True)
    scan = serving.latest(quakes, "CALIFORNIA", 5).collect()
    assert [r.event.event_id for r in found] == [r.event_id for r in scan]
    assert serving.seek(table, "NOWHERE").isEmpty()


def test_seek_opens_one_region_and_key_range(spark, quakes, tmp_path):
    table = _load(spark, quakes, tmp_path)
    text = plan(serving.seek(table, "ALASKA"))
    assert "TakeOrderedAndProject" in text
    assert "PartitionFilters: [isnotnull(region" in text
    assert "GreaterThanOrEqual(row_key,ALASKA#), LessThan(row_key,ALASKA$)" in text


def test_seek_one_reads_four_columns(spark, quakes, tmp_path):
    table = _load(spark, quakes, tmp_path)
    schema = plan(serving.seek_one(table, "ALASKA")).split("ReadSchema: ")[1]
    for absent in ("latitude", "felt", "depth_km"):
        assert absent not in schema
    strong = serving.seek_one(table, "ALASKA", 4.0).first()
    assert strong.mag >= 4.0


def test_last_write_wins_and_collisions(spark, quakes):
    rows = serving.serving_rows(quakes)
    changed = rows.withColumn("meta", F.col("meta").withField("alert", F.lit("new")))
    merged = serving.upsert(rows, changed)
    assert merged.count() == rows.count()
    assert merged.filter("meta.alert <> 'new'").isEmpty()
    same_instant = rows.limit(1).unionByName(
        rows.limit(1).withColumn("event", F.col("event").withField("event_id", F.lit("zz"))))
    assert tuple(serving.load_audit(same_instant).first()) == (2, 1, 1)
    kept = serving.upsert(same_instant.limit(0), same_instant).collect()
    assert [r.event.event_id for r in kept] == ["zz"]


def test_latest_of_every_region_limits_before_the_shuffle(quakes):
    rows = serving.latest_all(serving.serving_rows(quakes), 3)
    assert "WindowGroupLimit" in plan(rows)
    assert {r["count"] for r in rows.groupBy("region").count().collect()} == {3}


def test_loads_replace_themselves(spark, quakes, tmp_path):
    path = str(tmp_path / "loads")
    rows = serving.serving_rows(quakes)
    for _ in range(2):
        serving.append_load(rows, path, 1)
    serving.append_load(rows.filter("region = 'JAPAN'"), path, 2)
    loads = serving.read_loads(spark, path)
    assert loads.count() == rows.count() + rows.filter("region = 'JAPAN'").count()
    assert serving.last_write_wins(serving.in_key_range(loads, "JAPAN")).count() == \
        rows.filter("region = 'JAPAN'").count()


def test_seek_and_compact_loads(spark, quakes, tmp_path):
    path, target = str(tmp_path / "loads"), str(tmp_path / "table")
    rows = serving.serving_rows(quakes)
    serving.append_load(rows, path, 1)
    changed = rows.withColumn("meta", F.col("meta").withField("alert", F.lit("new")))
    serving.append_load(changed, path, 2)
    found = serving.seek_loads(serving.read_loads(spark, path), "ALASKA", 4)
    assert "GreaterThanOrEqual(row_key,ALASKA#), LessThan(row_key,ALASKA$)" in plan(found)
    expected = serving.latest(quakes, "ALASKA", 4).collect()
    assert [(r.event.event_id, r.meta.alert) for r in found.collect()] == [
        (r.event_id, "new") for r in expected]
    serving.compact_loads(spark, path, target)
    table = serving.read_serving(spark, target)
    assert table.count() == rows.count()
    assert serving.seek(table, "ALASKA", 4).select("row_key").collect() == \
        found.select("row_key").collect()


def test_retention(quakes):
    rows = serving.expire_event_family(serving.serving_rows(quakes), "2024-02-10")
    cut = 1707523200000 - 30 * 86_400_000
    assert rows.filter((F.col("epoch_millis") < cut) & F.col("event").isNotNull()).isEmpty()
    assert rows.filter((F.col("epoch_millis") >= cut) & F.col("event").isNull()).isEmpty()
    assert rows.filter("meta is null").isEmpty()


def test_a_load_keeps_one_row_per_key(spark, tmp_path):
    rows = [{"event_id": e, "epoch_millis": 7, "region": "JAPAN", "magnitude": 5.0}
            for e in ("a", "c", "b")]
    serving.write_serving(serving.serving_rows(quake_frame(spark, rows)), str(tmp_path / "s"))
    found = serving.read_serving(spark, str(tmp_path / "s")).collect()
    assert [r.event.event_id for r in found] == ["c"]


def test_a_load_replaces_the_ranges_it_touches(spark, quakes, tmp_path):
    """Ten keys replace ten key ranges at most; ranges stay disjoint and are cut as they grow."""
    path, rows = str(tmp_path / "table"), serving.serving_rows(quakes)
    serving.upsert_serving(rows, path, 0, part_rows=40)
    known = parts.manifest(spark, path)
    fences = sorted((s["low"], s["high"]) for s in known.stats.values())
    assert len(fences) > 15 and sum(s["rows"] for s in known.stats.values()) == rows.count()
    assert all(high < low for (_, high), (low, _) in zip(fences, fences[1:]))
    changed = rows.orderBy(F.xxhash64("row_key")).limit(10).withColumn(
        "meta", F.col("meta").withField("alert", F.lit("new")))
    touched = serving.upsert_serving(changed, path, 1, part_rows=40)
    after = parts.manifest(spark, path)
    assert 1 < len(touched) <= 10
    assert {p for p, s in after.slots.items() if known.slots.get(p) != s} == set(touched)
    table = serving.served(spark, path)
    assert table.filter("meta.alert = 'new'").count() == 10 and table.count() == rows.count()
    assert serving.upsert_serving(changed, path, 1) == []
    for region in ("CALIFORNIA", "ALASKA", "NOWHERE"):
        want = [r.row_key for r in serving.seek(rows, region, 5).collect()]
        opened = serving.served(spark, path, region)
        assert [r.row_key for r in serving.seek(opened, region, 5).collect()] == want
    own = plan(serving.served(spark, path, "ALASKA"))
    assert len(set(re.findall(r"k~0-\d+", own))) < len(known.slots) / 2
    # Whatever is loaded, no range holds more than twice its size after a cut.
    more = rows.withColumn("row_key", F.concat("row_key", F.lit("x")))
    serving.upsert_serving(more, path, 2, part_rows=40)
    last = parts.manifest(spark, path)
    assert max(s["rows"] for s in last.stats.values()) <= 100
    fences = sorted((s["low"], s["high"]) for s in last.stats.values())
    assert all(high < low for (_, high), (low, _) in zip(fences, fences[1:]))
    assert serving.served(spark, path).count() == 2 * rows.count()
