"""Wall time of the headline queries; prints one JSON line.

Each query is built and run to the end (no-op sink) once cold and ``BENCH_RUNS`` times warm;
its figure is the warm median. ``cold`` and the latency summary over all warm runs go along.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "e1a_hourly_activity", "e2_daily_activity", "e3_monthly_activity", "e4_weekly_activity",
    "e5a_regional_scorecard", "e6a_depth_strata", "e7_diurnal", "e8_frequency_magnitude",
    "e10_pager", "e15_hour_day_grid", "e17_depth_histogram", "e18_power_law",
    "e19_weekly_spikes", "e21_latency_summary", "e23_region_hourly", "e25_energy_share",
    "f1_running_energy_slice", "f3_first_at_or_after", "f4_rolling_counts",
    "b1_dedup", "b2_incremental_new", "b6a_flatten", "a4_parquet", "a12_serving_load",
    "h1a_latest_scan", "h1b_seek", "h1c_latest_all_regions", "h3_top_places", "h5_strata_sample",
    "a13_compaction", "g3_stream_land", "g4_stream_activity",
)
# Queries over an input that is made first; its time is given apart, as "prepare".
PREPARED = {"h1b_seek": "serving", "g3_stream_land": "streaming", "g4_stream_activity": "streaming"}
STREAMS = ("g3_stream_land", "g4_stream_activity")  # run once warm: they are whole jobs


def run(query, spark, *prepared):
    start = time.perf_counter()
    query(spark, SF_DIR, *prepared).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    from tremorlake import catalog
    from tremorlake.catalog import QUERIES
    from tremorlake.operators.statistics import latency_summary
    from tremorlake.session import local_session

    spark = local_session(CPUS, shuffle_partitions=CPUS if CPUS.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE
    cold, warm, samples, made, prepare = {}, {}, [], {}, {}
    for name in names:
        source = PREPARED.get(name)
        if source and source not in made:
            start = time.perf_counter()
            made[source] = getattr(catalog, source).prepare(spark, SF_DIR)
            prepare[source] = round(time.perf_counter() - start, 3)
        given = [made[source]] if source else []
        cold[name] = round(run(QUERIES[name], spark, *given), 3)
        times = [run(QUERIES[name], spark, *given) for _ in range(1 if name in STREAMS else RUNS)]
        warm[name] = round(statistics.median(times), 3)
        samples += [("warm", t * 1000) for t in times] + [("cold", cold[name] * 1000)]
        print(f"{name:34s} cold {cold[name]:7.3f} warm {warm[name]:7.3f}", file=sys.stderr, flush=True)
    runs = spark.createDataFrame(samples, "phase string, ms double")
    summary = {
        r.phase: {k: round(r[k], 2) for k in ("mean", "p50", "p95", "p99")}
        for r in latency_summary(runs, "phase", "ms").collect()
    }
    print(json.dumps({
        "metric": "sum of warm medians", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS,
        "cold": cold, "prepare": prepare, "latency_ms": summary,
    }))


if __name__ == "__main__":
    main()
