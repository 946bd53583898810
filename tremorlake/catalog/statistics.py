"""Frequency law, histograms, spikes, percentiles, correlation, energy share."""

from ..operators import filters, statistics
from ..sources.events_view import events, quakes
from .registry import as_text, oracle, query, rounded, terajoules

_FREQ = """freq AS (
  SELECT t / CAST(10 AS DOUBLE) AS magnitude, count(*) AS cumulative_count,
         log10(count(*)) AS log10_count
  FROM range(50, 84) thresholds(t) JOIN quakes ON mag10 >= t GROUP BY t)"""
_LINE = """line AS (
  SELECT regr_slope(log10_count, magnitude) AS slope, regr_r2(log10_count, magnitude) AS r2,
         regr_intercept(log10_count, magnitude) AS intercept, count(*) AS points
  FROM freq WHERE magnitude BETWEEN 4.99 AND 7.51)"""


@query("e8_frequency_magnitude", oracle("""
SELECT magnitude, cumulative_count, round(log10_count, 9) AS log10_count FROM freq""", _FREQ))
def frequency(spark, sf_dir):
    return rounded(statistics.frequency_magnitude(quakes(spark, sf_dir)), log10_count=9)


@query("e18_power_law", oracle("""
SELECT round(-slope, 6) AS b_value, round(intercept, 6) AS a_value, round(r2, 6) AS r2, points
FROM line""", _FREQ, _LINE))
def power_law(spark, sf_dir):
    return rounded(statistics.power_law(statistics.frequency_magnitude(quakes(spark, sf_dir))))


@query("e18_fitted_line", oracle("""
SELECT magnitude, round(log10_count, 6) AS log10_count,
       round(intercept + slope * magnitude, 6) AS fitted, round(-slope, 6) AS b_value,
       round(intercept, 6) AS a_value, round(r2, 6) AS r2
FROM freq, line""", _FREQ, _LINE))
def fitted_line(spark, sf_dir):
    return rounded(statistics.fit_power_law(statistics.frequency_magnitude(quakes(spark, sf_dir))))


def _histogram(name, column):
    sql = oracle(f"""
SELECT CAST(b AS INTEGER) AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
       count(v) AS event_count
FROM edges LEFT JOIN (SELECT {column} AS v FROM quakes WHERE mag10 >= 50)
  ON v >= lower AND (v < upper OR b = 34)
GROUP BY b, lower, upper""",
        f"""span AS (SELECT min({column}) AS lo, max({column}) AS hi FROM quakes WHERE mag10 >= 50)""",
        """edges AS (SELECT b, lo + b * ((hi - lo) / 35) AS lower, lo + (b + 1) * ((hi - lo) / 35) AS upper
                    FROM range(35) bins(b), span)""")

    @query(name, sql)
    def run(spark, sf_dir):
        return rounded(statistics.histogram(filters.major_or_all(quakes(spark, sf_dir)), column))


_histogram("e17_magnitude_histogram", "magnitude")
_histogram("e17_depth_histogram", "depth_km")


def _spikes(name, unit, sigmas, where, fill=False):
    counted = f"""counted AS (SELECT CAST(date_trunc('{unit}', event_time) AS TIMESTAMP) AS w,
        count(*) AS n FROM quakes WHERE {where} GROUP BY 1)"""
    source = "counted"
    parts = [counted]
    if fill:
        parts.append(f"""filled AS (SELECT w, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(
            (SELECT min(w) FROM counted), (SELECT max(w) FROM counted), INTERVAL 1 {unit})) AS w)
            LEFT JOIN counted USING (w))""")
        source = "filled"
    sql = oracle(f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS {unit}_window, n AS total_events, round(m, 6) AS mean_events,
       round(m + {sigmas}::DOUBLE * s, 6) AS threshold, n > m + {sigmas}::DOUBLE * s AS is_spike
FROM {source}, (SELECT avg(n) AS m, stddev_samp(n) AS s FROM {source})""", *parts)

    @query(name, sql)
    def run(spark, sf_dir):
        q = quakes(spark, sf_dir)
        rows = filters.major_in_window(q) if where != "true" else q
        found = statistics.spikes(rows, unit, sigmas, fill)
        return as_text(rounded(found), f"{unit}_window")


_spikes("e19_weekly_spikes", "week", 1.8, "mag10 >= 50")
_spikes("e19_hourly_spikes", "hour", 2.0, "true")
_spikes("e19_hourly_spikes_filled", "hour", 2.0, "mag10 >= 50", fill=True)


_SUMMARY = """summary AS (
  SELECT event_type, count(*) AS runs, avg(value) AS mean, quantile_cont(value, 0.5) AS p50,
         quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99
  FROM events GROUP BY 1)"""


@query("e21_latency_summary", "WITH " + _SUMMARY + """
SELECT event_type, runs, round(mean, 6) AS mean, round(p50, 6) AS p50, round(p95, 6) AS p95,
       round(p99, 6) AS p99 FROM summary""")
def latency(spark, sf_dir):
    return rounded(statistics.latency_summary(events(spark, sf_dir), "event_type", "value"))


@query("e21_mean_ratio", "WITH " + _SUMMARY + """
SELECT round((SELECT mean FROM summary WHERE event_type = 'click')
           / (SELECT mean FROM summary WHERE event_type = 'view'), 6) AS ratio""")
def ratio(spark, sf_dir):
    summary = statistics.latency_summary(events(spark, sf_dir), "event_type", "value")
    return rounded(statistics.mean_ratio(summary, "event_type", "click", "view"))


@query("e22_mag_depth_corr", oracle("""
SELECT count(*) AS event_count, round(corr(magnitude, depth_km), 6) AS correlation FROM quakes"""))
def correlation(spark, sf_dir):
    return rounded(statistics.mag_depth_corr(quakes(spark, sf_dir)))


@query("e22_mag_depth_corr_by_region", oracle("""
SELECT region, count(*) AS event_count, round(corr(magnitude, depth_km), 6) AS correlation
FROM quakes GROUP BY 1"""))
def correlation_by_region(spark, sf_dir):
    return rounded(statistics.mag_depth_corr(quakes(spark, sf_dir), "region"))


@query("e25_energy_share", oracle("""
SELECT round(total / 1e12, 3) AS total_energy_tj, round(top / 1e12, 3) AS top_energy_tj,
       round(top / total, 6) AS share
FROM (SELECT (SELECT sum(energy) FROM quakes) AS total,
             (SELECT sum(energy) FROM (SELECT energy FROM quakes ORDER BY energy DESC LIMIT 4)) AS top)"""))
def energy_share(spark, sf_dir):
    rows = statistics.energy_share(quakes(spark, sf_dir))
    rows = terajoules(rows, "total_energy_joules", "total_energy_tj")
    return rounded(terajoules(rows, "top_energy_joules", "top_energy_tj"), share=6)
