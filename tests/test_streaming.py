"""Streams over several micro-batches with re-delivery give the batch result."""

import glob
import statistics as statistics_module

import pytest
from pyspark.sql import functions as F

from helpers import plan
from tremorlake.operators import rollups, seen, serving, statistics
from tremorlake.operators.cleansing import flatten
from tremorlake.operators.filters import dispatch
from tremorlake.sources import parts, readers, writers
from tremorlake.streaming import delivery, ingest


@pytest.fixture(scope="module")
def polled(spark, features, tmp_path_factory):
    """Five polls in event-time order; each brings its six days and the six before again."""
    path = str(tmp_path_factory.mktemp("polls"))
    day = F.dayofmonth(F.timestamp_millis("properties.time"))
    for poll in range(5):
        window = features.filter(day.between(poll * 6 - 5, poll * 6 + 6))
        writers.land_features(window.coalesce(1), path, f"2024-02-01 0{poll}:00:00")
    return path


def _stream(spark, polled):
    return ingest.stream_features(spark, polled, max_files=1)


def test_land_dedup_resume(spark, features, polled, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    first = ingest.run(ingest.stream_land(_stream(spark, polled), out, checkpoint))
    landed = readers.read_landed(spark, out)
    assert landed.count() == features.count()
    assert landed.select("id").distinct().count() == features.count()
    totals = ingest.cycle_totals(ingest.progress(spark, first)).first()
    assert totals.cycles >= 5 and totals.landed == features.count() < totals.polled
    again = ingest.run(ingest.stream_land(_stream(spark, polled), out, checkpoint))
    assert ingest.cycle_totals(ingest.progress(spark, again)).first().landed == 0
    assert readers.read_landed(spark, out).count() == features.count()


def test_activity_equals_batch(spark, quakes, polled, tmp_path):
    out = str(tmp_path / "out")
    ingest.run(ingest.stream_activity(_stream(spark, polled), out, str(tmp_path / "cp")))
    got = ingest.current_activity(spark, out).select("hour_window", "total_events", "max_magnitude")
    expected = rollups.activity(quakes).select("hour_window", "total_events", "max_magnitude")
    assert sorted(got.collect()) == sorted(expected.collect())


def test_activity_is_bounded_and_replays(spark, polled, tmp_path):
    """Two folders a day and two manifests, however many batches; a batch merged again adds nothing."""
    out = str(tmp_path / "out")
    batches = []
    new = ingest._measured(ingest.stream_dedup(_stream(spark, polled)))

    def merge(batch, number):
        ingest.merge_activity(batch, out, number)
        before = sorted(ingest.current_activity(spark, out).collect())
        ingest.merge_activity(batch, out, number)
        assert sorted(ingest.current_activity(spark, out).collect()) == before
        batches.append(number)

    ingest.run(new.writeStream.foreachBatch(merge).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    days = glob.glob(f"{out}/data/part=*")
    assert len(batches) >= 5 and len(days) >= 25
    assert all(len(glob.glob(f"{d}/slot=*")) <= 2 for d in days)
    assert len(glob.glob(f"{out}/manifest/turn=*")) == 2


def test_spike_alerts(spark, quakes, polled, tmp_path):
    hours, out = str(tmp_path / "hours"), str(tmp_path / "out")
    ingest.run(ingest.stream_spikes(_stream(spark, polled), hours, out, str(tmp_path / "cp")))
    alerts = ingest.raised(spark, out)
    last = alerts.agg(F.max("batch")).first()[0]
    assert alerts.count() > 0 and last > 0
    got = ingest.current_spikes(spark, hours)
    batch = statistics.spikes(quakes, "hour", 2.0).filter("is_spike").first()
    assert sorted(r[0] for r in got.select("hour_window").collect()) == sorted(
        r[0] for r in statistics.spikes(quakes, "hour", 2.0).filter("is_spike").select(
            "hour_window").collect())
    row = got.filter(F.col("hour_window") == batch.hour_window).first()
    assert row.mean_events == pytest.approx(batch.mean_events, rel=1e-12)
    assert row.threshold == pytest.approx(batch.threshold, rel=1e-12)


def test_level_reads_no_stored_day(spark):
    """The level of all hours comes from the manifest: moments of any parts add up."""
    counts = [3, 1, 4, 1, 5, 9, 2, 6]
    stats = {f"d{k}": {"hours": len(c), "sum": sum(c), "squares": str(sum(x * x for x in c))}
             for k, c in enumerate((counts[:3], counts[3:]))}
    mean, limit = ingest.hourly_level(parts.Manifest(0, {}, stats), 2.0)
    assert mean == sum(counts) / 8
    assert limit == pytest.approx(mean + 2 * statistics_module.stdev(counts), rel=1e-12)


def test_dispatch_and_serving(spark, quakes, polled, tmp_path):
    out = str(tmp_path / "dispatch")
    ingest.run(ingest.stream_dispatch(_stream(spark, polled), out, str(tmp_path / "cp1")))
    got = sorted(r.event_id for r in spark.read.parquet(out).collect())
    assert got == sorted(r.event_id for r in dispatch(quakes).collect())

    table = str(tmp_path / "serving")
    ingest.run(ingest.stream_serving(_stream(spark, polled), table, str(tmp_path / "cp2")))
    assert parts.manifest(spark, table).version >= 4
    streamed = serving.served(spark, table).select("row_key", "event", "meta")
    batch = serving.serving_rows(quakes).select("row_key", "event", "meta")
    assert streamed.exceptAll(batch).isEmpty() and streamed.count() == batch.count()


def test_continuous_run_stops(spark, polled, tmp_path):
    query = ingest.stream_land(
        _stream(spark, polled), str(tmp_path / "out"), str(tmp_path / "cp"),
        trigger={"processingTime": "1 second"},
    )
    ingest.run(query, timeout=2)
    assert not query.isActive


def test_copies_are_combined_before_the_state(spark, features):
    many = features.select(
        F.lit("hot").alias("id"), "properties", "geometry", F.explode(F.sequence(F.lit(1), F.lit(30)))
    )
    combined = ingest._one_per_batch(many.select("id", "properties", "geometry").coalesce(1))
    assert combined.count() <= -(-features.count() * 30 // 10_000)
    assert flatten(combined).first().event_id == "hot"


def test_activity_moves_what_it_needs(spark, polled, tmp_path, monkeypatch):
    """Only id, magnitude and time of a feature go through Python, the shuffle and the state."""
    moved, keep = [], ingest._one_per_batch

    def seen_columns(rows):
        moved.append([(f.name, getattr(f.dataType, "names", None)) for f in rows.schema])
        return keep(rows)

    monkeypatch.setattr(ingest, "_one_per_batch", seen_columns)
    out = str(tmp_path / "out")
    ingest.run(ingest.stream_activity(_stream(spark, polled), out, str(tmp_path / "cp")))
    assert moved == [[("id", None), ("properties", ["mag", "time"])]]
    assert ingest.current_activity(spark, out).count() > 0


def test_narrow_documents_have_the_same_rows(spark, tmp_path):
    """Whatever is wrong with a feature, asking for two properties gives the rows of asking for all."""
    whole = '{"id":"%s","properties":{"mag":1,"time":5%s}%s}'
    odd = [
        whole % ("a", ',"felt":"x"', ""), whole % ("b", ',"felt":99999999999', ""),
        whole % ("c", "", ',"geometry":"no"'), whole % ("d", ',"place":{"a":1}', ',"geometry":[1]'),
        whole % ("e", "", ',"geometry":{"type":1,"coordinates":["a",2]}'),
        whole % ("f", ',"rms":1e999,"title":NaN', ""), '{"id":"g","properties":"text"}', '{"id":"h"}',
        '{"id":"i","properties":{"mag":"bad","time":5}}', '{"properties":{"mag":"NaN","time":5}}',
        '{"id":7,"properties":{"mag":1,"time":1.5}}', "null", '"text"', whole % ("j", ',"rms":01', ""),
    ]
    folder = tmp_path / "feed"
    folder.mkdir()
    for k, one in enumerate(odd):
        (folder / f"{k}.json").write_text(
            f'{{"features":[{whole % (f"x{k}", "", "")},{one},{whole % (f"y{k}", "", "")}]}}')
    (folder / "cut.json").write_text('{"features":[{"id":"cut","properties":{"mag":1,"time":1}},')
    got = []
    for n, properties in enumerate((None, ("mag", "time"))):
        rows = ingest.stream_features(spark, str(folder), properties=properties)
        rows = rows.select("id", F.col("properties").isNull().alias("none"), "properties.mag", "properties.time")
        ingest.run(rows.writeStream.format("parquet").trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / f"cp{n}")).start(str(tmp_path / f"out{n}")))
        read = spark.read.schema(rows.schema).parquet(str(tmp_path / f"out{n}"))
        got.append(sorted(repr(tuple(r)) for r in read.collect()))
    assert got[0] == got[1] and len(got[0]) > 30


def test_late_events_have_a_route(spark, sf_dir):
    """Out of time order, one file a batch: some events come after the horizon and are counted."""
    from tremorlake.catalog.streaming import _in_weeks
    from tremorlake.session import workspace
    from tremorlake.sources import readers

    feed, out = workspace(spark, "t-late"), workspace(spark, "t-late-out")
    _in_weeks(spark, sf_dir, feed)
    stream = ingest.stream_features(spark, feed, max_files=1, form="lines")
    done = ingest.run(ingest.stream_land(stream, out, workspace(spark, "t-late-check")))
    landed = readers.read_landed(spark, out).select("id")
    everything = readers.read_features_ndjson(spark, feed)
    late = ingest.late_features(everything, landed)
    totals = ingest.cycle_totals(ingest.progress(spark, done)).first()
    assert totals.cycles == 4 and late.count() > 0
    assert totals.late >= late.count()
    assert landed.count() + late.count() == everything.count()
    assert late.join(landed, "id").count() == 0


def _deliver(spark, feed, folder, fail=None):
    """Deliver the feed a file a batch; ``fail`` is called with each batch's number before it."""
    names = {n: f"{folder}/{n}" for n in ("out", "store", "alerts", "ledger")}

    def sink(batch, number):
        if fail:
            fail(number)
        delivery.deliver(batch, number, names["out"], names["store"], names["alerts"],
                         names["ledger"], "2024-02-01 10:00:00")

    stream = ingest.stream_features(spark, feed, max_files=1, form="lines")
    ingest.run(stream.writeStream.foreachBatch(sink).option(
        "checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return names


def test_delivery_survives_a_kill(spark, features, sf_dir, tmp_path, monkeypatch):
    """Killed at the last commit of the third batch and run again: every event once, totals exact."""
    from tremorlake.catalog.streaming import _in_weeks

    feed = str(tmp_path / "feed")
    _in_weeks(spark, sf_dir, feed)
    whole = _deliver(spark, feed, str(tmp_path / "whole"))
    commit, killed = seen.parts.commit, []

    def dying(rows, path, known, version, touched, totals=None, stats=None):
        if version == 2 and totals and not killed:
            killed.append(version)
            raise RuntimeError("killed")
        return commit(rows, path, known, version, touched, totals, stats)

    monkeypatch.setattr(seen.parts, "commit", dying)
    with pytest.raises(Exception, match="killed"):
        _deliver(spark, feed, str(tmp_path / "twice"))
    assert killed and delivery.totals(spark, str(tmp_path / "twice" / "store")).first().cycles == 2
    twice = _deliver(spark, feed, str(tmp_path / "twice"))
    ids = {}
    for name, made in (("whole", whole), ("twice", twice)):
        rows = delivery.delivered(spark, made["out"])
        ids[name] = sorted(tuple(r) for r in rows.select("id", "route").collect())
        assert len(ids[name]) == features.count() == rows.select("id").distinct().count()
        total = delivery.totals(spark, made["store"]).first()
        assert total.cycles == 4 and total.polled == total.landed + total.late == features.count()
        assert total.late == sum(r[1] == "late" for r in ids[name]) > 0
        assert delivery.cycles(spark, made["ledger"]).agg(F.sum("late")).first()[0] == total.late
        late = delivery.delivered_alerts(spark, made["alerts"]).filter("late").count()
        assert late > 0
    assert ids["whole"] == ids["twice"]


def test_seen_store_is_not_shuffled(spark, features, tmp_path):
    store = str(tmp_path / "seen")
    when = F.lit("2024-02-01").cast("timestamp")
    first, audit = seen.poll(features, store, 0, when)
    assert first.count() == features.count() == audit.first().seen
    few = features.limit(3)
    known = parts.manifest(spark, store)
    rows = parts.staged(seen.bucketed(few.unionByName(few.withColumn("id", F.lit("new")).limit(1))),
                        str(tmp_path / "few"))
    ids = seen.known_ids(rows, store, known)
    text = plan(ids)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert ids.count() == 3
    again, audit = seen.poll(features, store, 1, when)
    assert again.isEmpty() and audit.first().new == 0
    touched = len({r.part for r in rows.select("part").collect()})
    assert seen.unseen(rows, store, known).count() == 1 and touched <= 4
    # Ids that left the horizon go when their bucket is written again.
    later = F.lit("2024-03-01").cast("timestamp")
    fresh = parts.staged(seen.bucketed(features.withColumn("id", F.concat("id", F.lit("x")))),
                         str(tmp_path / "fresh"))
    seen.add(fresh, store, parts.manifest(spark, store), 2, later, 8)
    assert seen.seen_ids(spark, store).count() == features.count()
