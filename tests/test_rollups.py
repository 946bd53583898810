import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import plan, quake_frame
from tremorlake.operators import filters, ranking, rollups, statistics


def test_depth_labels_and_empty_alerts(spark):
    rows = [{"event_id": "a", "magnitude": 5.0, "depth_km": 35.0, "alert_level": "red",
             "tsunami_flag": 1, "felt_reports": 2, "region": "JAPAN"}]
    q = quake_frame(spark, rows)
    assert rollups.depth_strata(q).first().depth_category == "Intermediate (35-150 km)"
    assert [tuple(r) for r in rollups.alert_counts(q).collect()] == [
        ("green", 0), ("yellow", 0), ("orange", 0), ("red", 1)]
    assert [tuple(r) for r in rollups.alert_tsunami_pivot(q).collect()][3] == ("red", 0, 1)


def test_kpis_of_nothing(spark, quakes):
    nothing = filters.slice_quakes(quakes, 2.5, (0, 700), "NOWHERE")
    assert tuple(rollups.kpis(nothing).first()) == (0, 0.0, 0.0, 0)


def test_grid_always_has_168_cells(spark):
    q = quake_frame(spark, [{"event_id": "a", "epoch_millis": 1704067200000}])
    q = q.withColumn("event_time", F.timestamp_millis("epoch_millis"))
    grid = rollups.hour_day_grid(q).collect()
    assert len(grid) == 24 and all(len(r) == 8 for r in grid)
    assert grid[0].mon == 1 and sum(sum(r[1:]) for r in grid) == 1
    assert rollups.hot_cells(q).filter("hot").count() == 1
    assert rollups.hour_totals(q).first().mean_hourly == pytest.approx(1 / 24)


def test_frequency_two_decimal_magnitudes(spark):
    mags = [4.99, 5.0, 5.1, 5.15, 6.21, 8.3, 9.1, 5.3, 5.6, 6.7]
    q = quake_frame(spark, [{"event_id": str(i), "magnitude": m} for i, m in enumerate(mags)])
    got = {r.magnitude: r.cumulative_count for r in statistics.frequency_magnitude(q).collect()}
    for t in range(50, 84):
        expected = sum(round(m * 100) >= t * 10 for m in mags)
        assert got.get(t / 10, 0) == expected, t
    assert len(got) == 34


def test_frequency_drops_empty_thresholds_and_fits(spark):
    counts = [(5.0 + i / 10, int(10 ** (9 - 1.0 * (5.0 + i / 10)) * 10)) for i in range(26)]
    rows = spark.createDataFrame(
        [(m, n, math.log10(n)) for m, n in counts],
        "magnitude double, cumulative_count bigint, log10_count double")
    fit = statistics.power_law(rows).first()
    slope, intercept = np.polyfit([m for m, _ in counts], [math.log10(n) for _, n in counts], 1)
    assert fit.b_value == pytest.approx(-slope) and fit.a_value == pytest.approx(intercept)
    assert fit.points == 26 and 0.99 < fit.r2 <= 1
    assert statistics.fit_power_law(rows).count() == 26


@pytest.mark.parametrize("column", ["magnitude", "depth_km"])
def test_histogram(spark, quakes, column):
    rows = statistics.histogram(quakes, column).collect()
    values = [r[0] for r in quakes.select(column).collect()]
    counts, edges = np.histogram(values, 35)
    assert len(rows) == 35 and sum(r.event_count for r in rows) == len(values)
    assert rows[0].lower == pytest.approx(edges[0]) and rows[-1].upper == pytest.approx(edges[-1])
    if column == "depth_km":
        assert [r.event_count for r in rows] == list(counts)


def test_histogram_of_one_value(spark):
    q = quake_frame(spark, [{"event_id": "a", "magnitude": 5.0}, {"event_id": "b", "magnitude": 5.0}])
    rows = statistics.histogram(q, "magnitude").collect()
    assert (rows[0].lower, rows[-1].upper, rows[17].event_count) == (4.5, 5.5, 2)


def test_spikes_use_sample_deviation(spark):
    week = 7 * 86_400_000
    counts = [1, 1, 1, 0, 1, 9]
    rows = [{"event_id": f"{w}-{i}", "epoch_millis": 1704067200000 + w * week + i}
            for w, n in enumerate(counts) for i in range(n)]
    q = quake_frame(spark, rows)
    found = statistics.spikes(q).orderBy("week_window").collect()
    present = [c for c in counts if c]
    assert [r.total_events for r in found] == present
    limit = np.mean(present) + 1.8 * np.std(present, ddof=1)
    assert found[0].threshold == pytest.approx(limit)
    assert [r.is_spike for r in found] == [c > limit for c in present]
    filled = statistics.spikes(q, fill_gaps=True).orderBy("week_window").collect()
    assert [r.total_events for r in filled] == counts
    alone = statistics.spikes(q.limit(1)).first()
    assert alone.threshold is None and alone.is_spike is False


def test_window_fallback_without_action(spark, quakes):
    major = quakes.filter("magnitude >= 5")
    later = filters.major_in_window(quakes, "2030-01-01", "2031-01-01")
    assert later.count() == major.count()
    inside = filters.major_in_window(quakes, "2024-01-01", "2024-01-10")
    assert 0 < inside.count() < major.count()
    for rows in (later, inside):
        text = plan(rows)
        assert "subquery" in text.lower()
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_energy_share(spark):
    rows = [{"event_id": str(i), "seismic_energy_joules": e} for i, e in enumerate([1.0, 5.0, 3.0, 1.0])]
    share = statistics.energy_share(quake_frame(spark, rows), 2).first()
    assert share.share == pytest.approx(0.8)


def test_rankings(spark):
    rows = [
        {"event_id": "a", "place": "X, Chile", "magnitude": 8.0},
        {"event_id": "b", "place": "X, Chile", "magnitude": 9.0},
        {"event_id": "c", "place": "Y", "magnitude": 8.0},
        {"event_id": "d", "place": None, "magnitude": 7.0},
    ]
    q = quake_frame(spark, rows)
    got = [(r.event_id, r.label) for r in ranking.top_places(q).collect()]
    assert got == [("b", "Chile"), ("c", "Y"), ("d", None)]
    assert [r.event_id for r in ranking.top_places(q, 1).collect()] == ["b"]


def test_sample_is_exact_and_repeatable(spark, quakes):
    rows = quakes.select("event_id", "epoch_millis", "magnitude")
    first = ranking.strata_sample(rows, split=4.0, n=100)
    assert first.filter("stratum = 'moderate'").count() == 100
    assert first.filter("stratum = 'major'").count() == rows.filter("magnitude >= 4").count()
    again = ranking.strata_sample(rows.repartition(7), split=4.0, n=100)
    assert first.collect() == again.collect()
    other = ranking.strata_sample(rows, split=4.0, n=100, seed=1)
    assert set(other.collect()) != set(first.collect())
    assert ranking.strata_sample(rows, split=4.0, n=10**6).count() == rows.count()


def test_filters(quakes):
    assert filters.slice_quakes(quakes, 2.0).count() == quakes.count()
    assert filters.dispatch(quakes).filter(
        "tsunami_flag = 0 and alert_level not in ('yellow','orange','red')").isEmpty()
    assert filters.felt(quakes).agg(F.min("felt_reports")).first()[0] > 0
    assert filters.known_region(quakes).filter("region = 'GLOBAL_OTHER'").isEmpty()
