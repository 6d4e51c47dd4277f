"""Series statistics."""

from __future__ import annotations


from driftline.catalog.base import EVENT_SERIES, INDEXED, PROBS, SALES_SERIES, event_series, marker_probs, query, r, sales_series
from driftline.operators import forecast, series

SALES_X = SALES_SERIES + ",\n" + INDEXED.format(series="sales_series")
EVENT_X = EVENT_SERIES + ",\n" + INDEXED.format(series="event_series")


def t_two_sided(t: str, df: str) -> str:
    """Two-sided t probability for whole degrees of freedom: the finite trigonometric sum."""
    th, c2 = f"atan(abs({t}) / sqrt({df}))", f"({df} / ({df} + {t} * {t}))"
    odd = (f"(2 / pi() * ({th} + CASE WHEN {df} = 1 THEN 0 ELSE sin({th}) * cos({th}) * list_sum(list_transform(range(0, CAST(({df} - 1) / 2 AS BIGINT)), "
           f"lambda j: pow({c2}, j) * exp(2 * j * ln(2.0) + 2 * lgamma(j + 1.0) - lgamma(2 * j + 2.0)))) END))")
    even = (f"(sin({th}) * list_sum(list_transform(range(0, CAST({df} / 2 AS BIGINT)), "
            f"lambda j: pow({c2}, j) * exp(lgamma(2 * j + 1.0) - 2 * j * ln(2.0) - 2 * lgamma(j + 1.0)))))")
    return f"(1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


@query("linear_trend", f"""WITH {SALES_X}, s AS (SELECT series, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM indexed GROUP BY series)
SELECT series, {r('b')} AS slope, {r('a')} AS intercept, CASE WHEN b > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM s""")
def linear_trend(spark, folder):
    return series.trend(sales_series(spark, folder), ["series"])


@query("trend_line", f"""WITH {SALES_X}, s AS (SELECT series, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM indexed GROUP BY series)
SELECT series, time_bin, {r('value')} AS value, {r('a + b * x')} AS fitted FROM indexed JOIN s USING (series)""")
def trend_line(spark, folder):
    return series.trend_line(sales_series(spark, folder), ["series"])


@query("trend_significance", f"""WITH {EVENT_X}, s AS (SELECT series, count(*) AS n, regr_slope(value, x) AS slope, regr_r2(value, x) AS r2 FROM indexed GROUP BY series),
t AS (SELECT *, sign(slope) * sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM s), p AS (SELECT *, {t_two_sided('t', '(n - 2)')} AS p FROM t)
SELECT series, n, {r('slope')} AS slope, {r('r2')} AS r2, {r('t')} AS t, {r('p')} AS p_value,
  CASE WHEN p >= 0.05 THEN 'none' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM p""")
def trend_significance(spark, folder):
    return series.trend_significance(event_series(spark, folder), ["series"])


@query("series_changes", f"""WITH {SALES_SERIES}, d AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY time_bin) AS d FROM sales_series)
SELECT series, {r('avg(abs(d))')} AS mean_change, {r('max(abs(d))')} AS max_change, {r('stddev_samp(d)')} AS volatility FROM d GROUP BY series""")
def series_changes(spark, folder):
    return series.changes(sales_series(spark, folder), ["series"])


@query("series_peaks", f"""WITH {SALES_SERIES} SELECT a.series, a.time_bin AS peak_bin, {r('a.value')} AS peak, b.time_bin AS trough_bin, {r('b.value')} AS trough
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value DESC, time_bin) AS rn FROM sales_series) a
JOIN (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value, time_bin) AS rn FROM sales_series) b ON a.series = b.series AND a.rn = 1 AND b.rn = 1""")
def series_peaks(spark, folder):
    return series.peaks(sales_series(spark, folder), ["series"])


@query("series_zscore", f"""WITH {SALES_SERIES} SELECT series, time_bin, {r('(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9)')} AS z
FROM sales_series WINDOW w AS (PARTITION BY series)""")
def series_zscore(spark, folder):
    return series.zscore(sales_series(spark, folder), ["series"]).select("series", "time_bin", "z")


@query("directional_accuracy", f"""WITH {SALES_X}, f AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY x) AS forecast FROM indexed),
t AS (SELECT * FROM f WHERE n >= 10 AND x >= greatest(5, floor(n * 0.6::DOUBLE))),
d AS (SELECT series, CAST((value > lag(value) OVER w) = (forecast > lag(forecast) OVER w) AS DOUBLE) AS s FROM t WINDOW w AS (PARTITION BY series ORDER BY x))
SELECT series, {r('coalesce(avg(s), 0.5)')} AS directional_accuracy FROM d GROUP BY series""")
def directional_accuracy(spark, folder):
    return series.directional_accuracy(forecast.walk_forward(sales_series(spark, folder), ["series"]), ["series"])


@query("category_summary", f"""WITH {PROBS}, bins AS (SELECT category AS series, time_bin, avg(prob) AS value FROM probs GROUP BY ALL),
{INDEXED.format(series='bins')}, d AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY time_bin) AS d FROM bins)
SELECT category, {r('(SELECT avg(prob) FROM probs q WHERE q.category = c.category)')} AS mean_prob,
  {r('(SELECT regr_slope(value, x) FROM indexed i WHERE i.series = c.category)')} AS slope,
  CASE WHEN (SELECT regr_slope(value, x) FROM indexed i WHERE i.series = c.category) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  {r('(SELECT stddev_samp(d) FROM d WHERE d.series = c.category)')} AS volatility,
  (SELECT time_bin FROM bins b WHERE b.series = c.category ORDER BY value DESC, time_bin LIMIT 1) AS peak_bin,
  {r('(SELECT max(value) FROM bins b WHERE b.series = c.category)')} AS peak,
  (SELECT time_bin FROM bins b WHERE b.series = c.category ORDER BY value, time_bin LIMIT 1) AS trough_bin,
  {r('(SELECT min(value) FROM bins b WHERE b.series = c.category)')} AS trough
FROM (SELECT DISTINCT category FROM probs) c""")
def category_summary(spark, folder):
    return series.summary_report(marker_probs(spark, folder))
