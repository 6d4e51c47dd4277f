"""Forecasts, backtests, error measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.catalog.base import EVENT_SERIES, INDEXED, SALES_SERIES, event_series, query, r, sales_series
from driftline.catalog.vectors import TRAJECTORY, concept_trajectory_rows
from driftline.operators import forecast

SALES_X = SALES_SERIES + ",\n" + INDEXED.format(series="sales_series")
EVENT_X = EVENT_SERIES + ",\n" + INDEXED.format(series="event_series")
AHEAD = "CAST(step AS INTEGER) AS step, last + to_microseconds(CAST(round((epoch_us(last) - epoch_us(first)) / (n - 1) * step) AS BIGINT)) AS time_bin"
FIT = """fit AS (SELECT series, count(*) AS n, min(time_bin) AS first, max(time_bin) AS last, arg_max(value, time_bin) AS y,
  regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM indexed GROUP BY series)"""


@query("naive_forecast", f"""WITH {SALES_X}, {FIT} SELECT series, {AHEAD}, {r('y')} AS yhat, 'naive_last' AS model FROM fit, unnest(range(1, 7)) AS t(step)""")
def naive_forecast(spark, folder):
    return forecast.forecast(sales_series(spark, folder), ["series"], 6, "naive_last")


@query("trend_forecast", f"""WITH {SALES_X}, {FIT} SELECT series, {AHEAD}, {r('CASE WHEN n < 5 THEN y ELSE a + b * (n - 1 + step) END')} AS yhat,
  'linear_trend' AS model FROM fit, unnest(range(1, 13)) AS t(step)""")
def trend_forecast(spark, folder):
    return forecast.forecast(sales_series(spark, folder), ["series"], 12, "prophet")


@query("arima_forecast")
def arima_forecast(spark, folder):
    return forecast.forecast(sales_series(spark, folder), ["series"], 12, "auto_arima")


@query("short_series", f"""WITH {EVENT_SERIES}, few AS (SELECT * FROM event_series WHERE value > (SELECT avg(value) + 1.2 * stddev_samp(value) FROM event_series)),
{INDEXED.format(series='few')}, {FIT}
SELECT series, CAST(step AS INTEGER) AS step, {r('CASE WHEN n < 5 THEN y ELSE a + b * (n - 1 + step) END')} AS yhat FROM fit, unnest(range(1, 7)) AS t(step)""")
def short_series(spark, folder):
    rows = event_series(spark, folder)
    mark = rows.agg((F.avg("value") + 1.2 * F.stddev_samp("value")).alias("m")).scalar()
    return forecast.forecast(rows.filter(F.col("value") > mark), ["series"], 6, "linear_trend").select("series", "step", "yhat")


HOLDOUT = """split AS (SELECT *, {h} AS h FROM indexed),
trained AS (SELECT series, count(*) AS m, arg_max(value, x) AS y, regr_slope(value, x) AS b, regr_intercept(value, x) AS a
  FROM split WHERE x < n - h GROUP BY series),
scored AS (SELECT s.series, 'naive_last' AS model, s.value AS actual, t.y AS forecast FROM split s JOIN trained t USING (series) WHERE x >= n - h AND {fits}
  UNION ALL SELECT s.series, 'linear_trend', s.value, CASE WHEN m < 5 THEN t.y ELSE t.a + t.b * s.x END FROM split s JOIN trained t USING (series)
  WHERE x >= n - h AND {fits})"""


@query("holdout_backtest", f"""WITH {SALES_X}, {HOLDOUT.format(h='greatest(3, least(6, n // 4))', fits='n > h + 3')},
m AS (SELECT series, model, sqrt(avg((actual - forecast) ** 2)) AS rmse, avg(abs(actual - forecast)) AS mae,
  avg(abs((actual - forecast) / greatest(abs(actual), 1e-6))) AS mape FROM scored GROUP BY ALL)
SELECT s.series, k.model, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('mape')} AS mape FROM (SELECT DISTINCT series FROM sales_series) s
CROSS JOIN (SELECT unnest(['naive_last', 'linear_trend']) AS model) k LEFT JOIN m ON m.series = s.series AND m.model = k.model""")
def holdout_backtest(spark, folder):
    return forecast.backtest(sales_series(spark, folder), ["series"], ["naive_last", "linear_trend"])


METRICS = f"""SELECT series, model, {r('avg(abs(actual - forecast))')} AS mae, {r('sqrt(avg((actual - forecast) ** 2))')} AS rmse,
  {r('avg(abs(actual - forecast) / (abs(actual) + 1e-6)) * 100')} AS mape_pct,
  {r('1 - sum((actual - forecast) ** 2) / (var_pop(actual) * count(*))')} AS r2"""


@query("forecaster_comparison", f"""WITH {SALES_X}, {HOLDOUT.format(h='least(12, greatest(2, n // 4))', fits='n >= 12')} {METRICS} FROM scored GROUP BY ALL""")
def forecaster_comparison(spark, folder):
    return forecast.compare_forecasters(sales_series(spark, folder), ["series"], 12, ["linear_trend", "naive_last"])


@query("forecaster_comparison_arima")
def forecaster_comparison_arima(spark, folder):
    return forecast.compare_forecasters(sales_series(spark, folder), ["series"])


WALK = """walk AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY x) AS naive,
  regr_intercept(value, x) OVER p + regr_slope(value, x) OVER p * x AS line FROM indexed
  WINDOW p AS (PARTITION BY series ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scored AS (SELECT series, x, value AS actual, 'naive_last' AS model, naive AS forecast FROM walk WHERE n >= 10 AND x >= greatest(5, floor(n * {share}::DOUBLE))
  UNION ALL SELECT series, x, value, 'linear_trend', line FROM walk WHERE n >= 10 AND x >= greatest(5, floor(n * {share}::DOUBLE)))"""


@query("walk_forward_metrics", f"""WITH {SALES_X}, {WALK.format(share='0.6')}, m AS (
  SELECT series, model, count(*) AS points, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse,
    avg(abs((actual - forecast) / greatest(abs(actual), 1e-6))) AS mape, avg(abs(actual - forecast) / (abs(actual) + 1e-6)) * 100 AS mape_pct,
    avg(abs((actual - forecast) / (actual + 1e-10))) * 100 AS mape_raw_pct, sum((actual - forecast) ** 2) AS sse,
    var_pop(actual) * count(*) AS sst, corr(actual, forecast) AS r FROM scored GROUP BY ALL)
SELECT series, model, points, {r('mae')} AS mae, {r('rmse')} AS rmse, {r('mape')} AS mape, {r('mape_pct')} AS mape_pct, {r('mape_raw_pct')} AS mape_raw_pct,
  {r('1 - sse / sst')} AS r2, {r('1 - sse / (sst + 1e-10)')} AS r2_guarded, {r('greatest(0, 1 - sse / (sst + 1e-10))')} AS r2_clipped, {r('r')} AS r FROM m""")
def walk_forward_metrics(spark, folder):
    return forecast.walk_forward_errors(sales_series(spark, folder), ["series"], ["naive_last", "linear_trend"])


@query("walk_forward_half", f"""WITH {EVENT_X}, {WALK.format(share='0.5')}
SELECT series, model, CAST(x AS BIGINT) AS x, {r('actual')} AS actual, {r('forecast')} AS forecast FROM scored""")
def walk_forward_half(spark, folder):
    rows = event_series(spark, folder)
    both = [forecast.walk_forward(rows, ["series"], m, 0.5).withColumn("model", F.lit(m)) for m in ("naive_last", "linear_trend")]
    return both[0].unionByName(both[1]).select("series", "model", "x", "actual", "forecast")


@query("walk_forward_arima")
def walk_forward_arima(spark, folder):
    return forecast.error_metrics(forecast.walk_forward(event_series(spark, folder), ["series"], "auto_arima"), ["series"])


@query("unit_root", f"""WITH {SALES_SERIES}, d AS (SELECT series, value - lag(value) OVER w AS d, lag(value) OVER w AS p FROM sales_series
  WINDOW w AS (PARTITION BY series ORDER BY time_bin)),
m AS (SELECT series, count(*) AS n, regr_sxx(d, p) AS sxx, regr_syy(d, p) AS syy, regr_sxy(d, p) AS sxy FROM d WHERE p IS NOT NULL GROUP BY series),
t AS (SELECT series, n, (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t, -2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3 AS c FROM m)
SELECT series, n AS t_obs, {r('t')} AS t, {r('c')} AS critical, t < c AS stationary FROM t""")
def unit_root(spark, folder):
    return forecast.unit_root(sales_series(spark, folder), ["series"])


@query("unit_root_lagged", f"""WITH {SALES_SERIES}, l AS (SELECT series, value AS y, lag(value) OVER w AS y1, lag(value, 2) OVER w AS y2 FROM sales_series WINDOW w AS (PARTITION BY series ORDER BY time_bin)),
d AS (SELECT series, y - y1 AS d, y1 AS p, y1 - y2 AS q FROM l WHERE y2 IS NOT NULL),
m AS (SELECT series, count(*) AS n, regr_sxx(d, p) AS pp, regr_sxx(d, q) AS qq, regr_sxy(q, p) AS pq, regr_sxy(d, p) AS dp, regr_sxy(d, q) AS dq, regr_syy(d, p) AS dd FROM d GROUP BY series),
b AS (SELECT *, (qq * dp - pq * dq) / (pp * qq - pq * pq) AS b_p, (pp * dq - pq * dp) / (pp * qq - pq * pq) AS b_q FROM m)
SELECT series, n AS t_obs, CAST(1 AS INTEGER) AS lags, {r('b_p / sqrt((dd - b_p * dp - b_q * dq) / (n - 3) * qq / (pp * qq - pq * pq))')} AS t,
  {r('-2.86154 - 2.8903 / n - 4.234 / n ** 2 - 40.04 / n ** 3')} AS critical_5 FROM b""")
def unit_root_lagged(spark, folder):
    return forecast.augmented_unit_root(sales_series(spark, folder), ["series"], 1).select("series", "t_obs", "lags", "t", "critical_5")


@query("unit_root_aic")
def unit_root_aic(spark, folder):
    return forecast.augmented_unit_root(sales_series(spark, folder), ["series"])


AR = f"""{SALES_SERIES}, c AS (SELECT series, time_bin, value - avg(value) OVER (PARTITION BY series) AS c, avg(value) OVER (PARTITION BY series) AS m FROM sales_series),
l AS (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY series ORDER BY time_bin)),
g AS (SELECT series, count(*) AS n, max(m) AS mean, sum(c * c) / count(*) AS r0, sum(c * c1) / count(*) AS r1, sum(c * c2) / count(*) AS r2 FROM l GROUP BY series),
one AS (SELECT *, r1 / r0 AS a, r0 * (1 - (r1 / r0) ** 2) AS e1 FROM g), two AS (SELECT *, (r2 - a * r1) / e1 AS b2 FROM one),
fits AS (SELECT *, a - b2 * a AS b1, e1 * (1 - b2 * b2) AS e2, n * ln(r0) + 2 AS i0, n * ln(e1) + 4 AS i1, n * ln(e1 * (1 - b2 * b2)) + 6 AS i2 FROM two),
best AS (SELECT *, CASE WHEN i0 <= least(i1, i2) THEN 0 WHEN i1 <= i2 THEN 1 ELSE 2 END AS k FROM fits)"""


@query("autoregression", f"""WITH {AR} SELECT series, n, {r('mean')} AS mean, CAST(k AS INTEGER) AS "order", {r('CASE k WHEN 0 THEN 0 WHEN 1 THEN a ELSE b1 END')} AS phi1,
  {r('CASE k WHEN 2 THEN b2 ELSE 0 END')} AS phi2, {r('CASE k WHEN 0 THEN r0 WHEN 1 THEN e1 ELSE e2 END')} AS sigma2 FROM best""")
def autoregression(spark, folder):
    fit = forecast.autoregression(sales_series(spark, folder), ["series"], 2)
    return fit.select("series", "n", "mean", "order", F.col("phi")[0].alias("phi1"), F.col("phi")[1].alias("phi2"), "sigma2")


@query("concept_forecasts", f"""WITH {TRAJECTORY}, src AS (SELECT concept AS series, time_bin, value FROM traj),
{INDEXED.format(series='src')}, {FIT}
SELECT series AS concept, {AHEAD}, {r('CASE WHEN n < 5 THEN y ELSE a + b * (n - 1 + step) END')} AS yhat, 'linear_trend' AS model FROM fit, unnest(range(1, 13)) AS t(step)""")
def concept_forecasts(spark, folder):
    return forecast.forecast(concept_trajectory_rows(spark, folder).drop("source"), ["concept"], 12, "linear_trend")
