"""Skewed fixtures against brute force."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import plan, quake_frame
from tremorlake.operators import running, statistics
from tremorlake.plans.slices import SKETCH_K, sketched_cuts
from tremorlake.sources import parts


def _events(n=900, seed=3):
    """A third in one millisecond, a third in one hour, the rest over some days."""
    rng = random.Random(seed)
    base = 1704067200000
    rows = []
    for i in range(n):
        ms = base + (5 if i % 3 == 0 else rng.randrange(3_600_000) if i % 3 == 1
                     else rng.randrange(5 * 86_400_000))
        rows.append({
            "event_id": f"q{i:05d}", "epoch_millis": ms, "magnitude": 5.0,
            "region": "HOT" if i % 4 else "COOL", "seismic_energy_joules": float(rng.randrange(1, 99)) * 1e15,
        })
    return rows


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_running_energy(spark, slices):
    rows = _events()
    frame = quake_frame(spark, rows).select("event_id", "epoch_millis", "seismic_energy_joules")
    out = running.running_energy(frame, slices).orderBy("cum_events").collect()
    assert [r.cum_events for r in out] == list(range(1, len(rows) + 1))
    times = [r.epoch_millis for r in out]
    assert times == sorted(times)
    total = 0
    for r in out:
        total += r.seismic_energy_joules / 1e15
        assert r.cum_energy_pj == pytest.approx(total)
    # The order of ties does not depend on the slicing.
    again = running.running_energy(frame, 5).orderBy("cum_events").collect()
    assert [r.event_id for r in again] == [r.event_id for r in out]


def test_running_energy_splits_one_millisecond(spark):
    """All events share one instant, and still several slices share the work."""
    from tremorlake.plans.slices import SLICE, sliced

    rows = [dict(r, epoch_millis=7) for r in _events(600)]
    frame = quake_frame(spark, rows)
    parts, _ = sliced(frame, F.col("epoch_millis"), "event_id", 8)
    sizes = [r["count"] for r in parts.groupBy(SLICE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 150


def test_running_energy_has_no_global_window(spark, quakes):
    text = plan(running.running_energy(quakes.select("event_id", "epoch_millis", "seismic_energy_joules")))
    for line in text.splitlines():
        if "Exchange SinglePartition" in line:
            # Only the slice totals meet in one task.
            assert "_slice" in text[text.index(line):text.index(line) + 600]
    assert "BatchEvalPython" not in text


def test_empty_running(spark, quakes):
    none = quakes.filter("magnitude > 100").select("event_id", "epoch_millis", "seismic_energy_joules")
    assert running.running_energy(none).count() == 0


def test_rolling_counts(spark):
    rows = _events()
    out = running.rolling_counts(quake_frame(spark, rows)).collect()
    by_region = {}
    for r in rows:
        by_region.setdefault(r["region"], []).append(r["epoch_millis"])
    assert len(out) == sum(len(set(t)) for t in by_region.values())
    for times in by_region.values():
        times.sort()
    for r in out:
        times = by_region[r.region]
        upto = bisect.bisect_right(times, r.epoch_millis)
        assert r.events == upto - bisect.bisect_left(times, r.epoch_millis)
        for hours in (1, 6, 24):
            first = bisect.bisect_left(times, r.epoch_millis - hours * 3_600_000)
            assert r[f"last_{hours}h"] == upto - first


def test_first_at_or_after(spark):
    rows = _events()
    frame = quake_frame(spark, rows).select("event_id", "epoch_millis", "magnitude")
    base = 1704067200000
    instants = [base - 1, base + 5, base + 6, base + 86_400_000, base + 10 * 86_400_000]
    got = {r.instant_millis: (r.epoch_millis, r.event_id)
           for r in running.first_at_or_after(frame, instants).collect()}
    for t in instants:
        after = [(r["epoch_millis"], r["event_id"]) for r in rows if r["epoch_millis"] >= t]
        if after:
            assert got.pop(t) == min(after)
    assert not got


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_exact_percentiles(spark, slices):
    """One group holds most rows and one value half of those."""
    rng = random.Random(5)
    data = [("hot", 6320.0 if i % 2 else rng.expovariate(1 / 50)) for i in range(700)]
    data += [("cool", rng.expovariate(1 / 3)) for _ in range(41)] + [("one", 2.5), ("two", 1.0), ("two", 4.0)]
    frame = spark.createDataFrame(data + [("one", None)], "engine string, ms double")
    for r in statistics.latency_summary(frame, "engine", "ms", slices=slices).collect():
        values = [v for e, v in data if e == r.engine]
        assert r.runs == len(values) and r["mean"] == pytest.approx(np.mean(values))
        assert [r.p50, r.p95, r.p99] == pytest.approx(list(np.percentile(values, [50, 95, 99])))


def test_percentiles_read_the_input_twice(spark, tmp_path):
    """Once for the sketch of the cuts, once for the counted values; infinities are values."""
    spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cool").alias("engine"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 17 == 0, float("inf"))
        .otherwise(F.hash("id") % 20_000 / 8).alias("ms"),
    ).write.parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    found = statistics.latency_summary(runs, "engine", "ms")
    shares = F.array(*[F.lit(p) for _, p in statistics.PERCENTILES])
    want = {r.engine: r.q for r in runs.groupBy("engine").agg(
        F.percentile("ms", shares).alias("q")).collect()}
    assert {r.engine: [r.p50, r.p95, r.p99] for r in found.collect()} == want
    final = plan(found).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert statistics.latency_summary(runs.limit(0), "engine", "ms").count() == 0


@pytest.mark.parametrize("k", [2, 64, 50_000])
def test_sketched_cuts_balance(spark, k):
    rows = spark.range(100_000).select((F.col("id") * 1.0).alias("v"))
    cuts = sketched_cuts(rows, "v", k)
    assert len(cuts) == min(k, SKETCH_K // 8) - 1 and cuts == sorted(cuts)
    gaps = np.diff([0, *cuts, 100_000])
    assert gaps.max() <= 1.1 * 100_000 / min(k, SKETCH_K // 8) + 100


def test_mean_ratio(spark):
    frame = spark.createDataFrame([("a", 6.0), ("a", 10.0), ("b", 2.0), ("z", 0.0)], "e string, ms double")
    summary = statistics.latency_summary(frame, "e", "ms")
    assert statistics.mean_ratio(summary, "e", "a", "b").first().ratio == 4.0
    assert statistics.mean_ratio(summary, "e", "a", "z").first().ratio == 1.0


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_ties_are_in_id_order(spark, slices):
    rows = _events(400)
    frame = quake_frame(spark, rows).select("event_id", "epoch_millis")
    out = running.event_number(frame, slices).orderBy("cum_events").collect()
    assert [r.event_id for r in out] == [
        r["event_id"] for r in sorted(rows, key=lambda r: (r["epoch_millis"], r["event_id"]))]


def test_no_instants_no_rows(spark):
    frame = quake_frame(spark, _events(10))
    out = running.first_at_or_after(frame, [])
    assert out.count() == 0 and "instant_millis" in out.columns


@pytest.mark.parametrize("values", [
    [4.5 + k / 10 for k in range(40) for _ in range(k % 7 + 1)],
    [5.0, 5.1, 5.2, 8.5], [6.0, 6.0], [0.1 * k for k in range(100)],
])
def test_histogram_is_decided_by_its_edges(spark, values):
    frame = quake_frame(spark, [{"event_id": str(k), "magnitude": float(v)}
                                for k, v in enumerate(values)])
    out = statistics.histogram(frame, "magnitude").orderBy("bin").collect()
    assert [r.event_count for r in out] == np.histogram(values, bins=35)[0].tolist()


def test_running_index_extends(spark, tmp_path):
    """A new day and a late event rewrite their own days only, and the totals are those of one run
    over everything; from a day on, earlier days are not opened."""
    path = str(tmp_path / "index")
    frame = quake_frame(spark, _events()).withColumn(
        "dt", F.date_format(F.timestamp_millis("epoch_millis"), "yyyy-MM-dd"))
    late = F.col("event_id").isin("q00000", "q00003", "q00007")
    assert len(running.extend_index(frame.filter("dt < '2024-01-04'").filter(~late), path, 0, 7)) == 3
    first = parts.manifest(spark, path)
    assert running.extend_index(frame.filter("dt >= '2024-01-04'").filter(~late), path, 1) == [
        "2024-01-04", "2024-01-05"]
    days = running.extend_index(frame.filter(late), path, 2, 3)
    assert running.extend_index(frame, path, 2) == []
    last = parts.manifest(spark, path)
    kept = set(first.slots) - set(days)
    assert kept and all(last.slots[d] == first.slots[d] for d in kept)
    got = {r.event_id: r for r in running.running_index(spark, path).collect()}
    for r in running.running_energy(frame).collect():
        assert got[r.event_id].cum_events == r.cum_events
        assert got[r.event_id].cum_energy_pj == pytest.approx(r.cum_energy_pj, rel=1e-12)
    text = plan(running.running_index(spark, path, "2024-01-05"))
    assert "2024-01-05" in text and "2024-01-03" not in text.split("PartitionFilters")[1].split("]")[0]
