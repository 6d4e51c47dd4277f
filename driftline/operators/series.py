"""Statistics of bin-level series in long form: (series..., time_bin, value).

A series is never longer than its calendar, so windows partitioned by series stay small however many documents feed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.stats import t_tail
from driftline.session import settle


def _by(keys: list[str]):
    return Window.partitionBy(*keys)


def with_index(df: DataFrame, keys: list[str], time: str = "time_bin", out: str = "x") -> DataFrame:
    """Add the 0-based position within the series."""
    return df.withColumn(out, (F.row_number().over(_by(keys).orderBy(time)) - 1).cast("bigint"))


def series_stats(df: DataFrame, keys: list[str], time: str = "time_bin", value: str = "value") -> DataFrame:
    """Points, range, mean, sample std."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
    )


def peaks(df: DataFrame, keys: list[str], time: str = "time_bin", value: str = "value") -> DataFrame:
    """First bin of the highest and of the lowest value, with those values."""
    pick = F.struct(F.col(value).alias("v"), F.col(time).alias("t"))
    flip = F.struct((-F.col(value)).alias("v"), F.col(time).alias("t"))
    out = df.groupBy(*keys).agg(F.min(flip).alias("hi"), F.min(pick).alias("lo"))
    return out.select(*keys, F.col("hi.t").alias("peak_bin"), (-F.col("hi.v")).alias("peak"),
                      F.col("lo.t").alias("trough_bin"), F.col("lo.v").alias("trough"))


def trend(df: DataFrame, keys: list[str], time: str = "time_bin", value: str = "value") -> DataFrame:
    """Least-squares slope and intercept against the position, and its direction."""
    out = with_index(df, keys, time).groupBy(*keys).agg(
        F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept")
    )
    return out.withColumn("direction", F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"))


def trend_line(df: DataFrame, keys: list[str], time: str = "time_bin", value: str = "value") -> DataFrame:
    """Each point with the fitted value of the series' trend."""
    w = _by(keys)
    rows = with_index(df, keys, time)
    return rows.withColumn(
        "fitted", F.regr_intercept(value, "x").over(w) + F.regr_slope(value, "x").over(w) * F.col("x")
    ).drop("x")


def trend_significance(df: DataFrame, keys: list[str], time: str = "time_bin", value: str = "value",
                       alpha: float = 0.05) -> DataFrame:
    """Slope, R2, t statistic and two-sided p-value of the linear trend; a verdict at `alpha`.

    A constant series has R2 0 and p 1. An exact line has p 0. One or two points give nulls.
    """
    m = with_index(df, keys, time).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(value, "x").alias("slope"),
        F.regr_sxx(value, "x").alias("sxx"), F.regr_syy(value, "x").alias("syy"), F.regr_sxy(value, "x").alias("sxy"),
    )
    r2 = F.when(F.col("n") <= 2, None).when(F.col("syy") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))))
    m = m.withColumn("r2", r2)
    t = F.when(F.col("r2").isNull(), None).when(F.col("r2") < 1, F.signum("slope") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))).otherwise(
        F.signum("slope") * F.lit(float("inf")))
    m = m.withColumn("t", t).withColumn("p_value", t_tail(F.col("t"), F.col("n") - 2))
    verdict = F.when(F.col("p_value").isNull(), None).when(F.col("p_value") >= alpha, "none").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return m.select(*keys, "n", "slope", "r2", "t", "p_value", verdict.alias("trend"))


def changes(df: DataFrame, keys: list[str], time: str = "time_bin", value: str = "value") -> DataFrame:
    """Mean and largest absolute step, and volatility (sample std of the steps)."""
    step = F.col(value) - F.lag(value).over(_by(keys).orderBy(time))
    rows = df.withColumn("__d", step)
    return rows.groupBy(*keys).agg(
        F.avg(F.abs("__d")).alias("mean_change"), F.max(F.abs("__d")).alias("max_change"),
        F.stddev_samp("__d").alias("volatility"),
    )


def zscore(df: DataFrame, keys: list[str], value: str = "value", eps: float = 1e-9) -> DataFrame:
    """Value scaled by the series' mean and population std."""
    w = _by(keys)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(eps)))


def frequency(df: DataFrame, keys: list[str], time: str = "time_bin") -> DataFrame:
    """Typical step of a series in seconds: average and median."""
    micros = F.expr(f"timestampdiff(MICROSECOND, lag({time}) over (partition by {', '.join(keys)} order by {time}), {time})")
    rows = df.withColumn("__s", micros / F.lit(1e6))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__s").alias("mean_step"), F.percentile("__s", 0.5).alias("median_step")
    )


MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def calendar_frequency(df: DataFrame, keys: list[str], time: str = "time_bin") -> DataFrame:
    """The calendar step of a series: (keys, n, freq, unit, every, median_step).

    In this order: years, quarters and months counted from their first or last day (YS, QS, MS; YE, QE, ME), weeks (W) and days (D), business days (B), then
    hours, minutes and seconds (h, min, s). `freq` is the name with its multiple and anchor (2MS, QE-MAR, W-MON), null where no calendar fits or there
    are under three different times; the median step in seconds is what is left then. One pass of windows and one aggregate.
    """
    rows = df.select(*keys, F.col(time).cast("timestamp_ntz").alias("__t")).filter(F.col("__t").isNotNull()).distinct()
    own = Window.partitionBy(*keys).orderBy("__t")
    last = F.lag("__t").over(own)
    month = F.year("__t") * 12 + F.month("__t")
    clock = F.hour("__t") * 3600 + F.minute("__t") * 60 + F.second("__t")
    rows = rows.select(
        *keys, "__t", clock.alias("__clock"), F.expr("timestampdiff(MICROSECOND, date_trunc('SECOND', __t), __t)").alias("__part"),
        (F.expr("timestampdiff(MICROSECOND, lag(__t) over (partition by {0} order by __t), __t)".format(", ".join(f"`{k}`" for k in keys))) / F.lit(1e6)).alias("__s"),
        (month - F.lag(month).over(own)).alias("__m"), (F.day("__t") == 1).alias("__first"), (F.to_date("__t") == F.last_day("__t")).alias("__last"),
        F.weekday("__t").alias("__day"), F.weekday(last).alias("__before"))
    business = (F.col("__day") < 5) & (F.col("__s").isNull() | (F.col("__s") == 86400) | ((F.col("__s") == 3 * 86400) & (F.col("__before") == 4)))
    one = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("__s").alias("lo"), F.max("__s").alias("hi"), F.percentile("__s", 0.5).alias("median_step"),
        F.min("__m").alias("m"), F.max("__m").alias("m_hi"), F.every("__first").alias("first"), F.every("__last").alias("last"), F.every(business).alias("business"),
        (F.min("__clock") == F.max("__clock")).alias("same_clock"), F.max("__part").alias("part"), F.max("__t").alias("t"))
    fixed = F.col("lo") == F.col("hi")
    months = F.col("same_clock") & (F.col("first") | F.col("last")) & (F.col("m") == F.col("m_hi"))
    kind = lambda letter: F.concat(F.lit(letter), F.when(F.col("first"), "S").otherwise("E"))
    day, whole = F.col("lo") % 86400 == 0, F.col("lo") % 1 == 0
    unit = (
        F.when(F.col("n") < 3, None).when(months & (F.col("m") % 12 == 0), kind("Y")).when(months & (F.col("m") % 3 == 0), kind("Q")).when(months, kind("M"))
        .when(fixed & (F.col("lo") % (7 * 86400) == 0), "W").when(fixed & day, "D").when(F.col("same_clock") & F.col("business"), "B")
        .when(fixed & (F.col("lo") % 3600 == 0), "h").when(fixed & (F.col("lo") % 60 == 0), "min").when(fixed & whole, "s"))
    size = {"Y": F.col("m") / 12, "Q": F.col("m") / 3, "M": F.col("m"), "W": F.col("lo") / (7 * 86400), "D": F.col("lo") / 86400, "h": F.col("lo") / 3600, "min": F.col("lo") / 60, "s": F.col("lo")}
    one = one.withColumn("unit", unit)
    every = F.lit(1)
    for name, n in size.items():
        every = F.when(F.col("unit").startswith(name) & (F.length("unit") == (2 if name in "YQM" else len(name))), n).otherwise(every)
    table = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), at)
    last_quarter = (F.month("t") - 1) % 3 + 10  # quarters are named by their month in the year's last one
    anchor = (
        F.when(F.col("unit").startswith("Y"), table(MONTHS, F.month("t"))).when(F.col("unit").startswith("Q"), table(MONTHS, last_quarter.cast("int")))
        .when(F.col("unit") == "W", table(DAYS, F.weekday("t") + 1)))
    one = one.withColumn("every", F.when(F.col("unit").isNotNull(), every.cast("int")))
    name = F.concat(F.when(F.col("every") > 1, F.col("every").cast("string")).otherwise(""), F.col("unit"), F.coalesce(F.concat(F.lit("-"), anchor), F.lit("")))
    return one.select(*keys, "n", name.alias("freq"), "unit", "every", "median_step")


def calendar_future(df: DataFrame, keys: list[str], steps: int, time: str = "time_bin") -> DataFrame:
    """The next `steps` times of every series on its calendar, by its median step where it has none, by days after a single point."""
    last = df.groupBy(*keys).agg(F.max(F.col(time).cast("timestamp_ntz")).alias("__last"))
    rows = calendar_frequency(df, keys, time).join(last, keys).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    by = F.col("every") * F.col("step")
    months = by * F.when(F.col("unit").startswith("Y"), 12).when(F.col("unit").startswith("Q"), 3).otherwise(1)
    clock = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', __last), __last)")
    # Months keep the clock of the last time; month ends stay month ends.
    begin = F.add_months("__last", months)
    day = F.when(F.col("unit").endswith("E"), F.last_day(begin)).otherwise(begin).cast("timestamp_ntz")
    moved = lambda start, seconds: F.timestamp_add("MICROSECOND", seconds, start)
    weekday = F.weekday("__last")
    business = F.col("step") + 2 * F.floor((weekday + F.col("step")) / 5)
    seconds = F.when(F.col("unit") == "B", business * 86400).when(F.col("unit").isNotNull(), by * _seconds()).otherwise(F.coalesce("median_step", F.lit(86400.0)) * F.col("step"))
    micros = F.round(seconds * 1e6).cast("long")
    when = F.when(F.length("unit") == 2, moved(day, clock)).otherwise(moved(F.col("__last"), micros))
    return rows.select(*keys, "step", "freq", when.alias(time))


def _seconds() -> Column:
    return F.when(F.col("unit") == "W", 7 * 86400).when(F.col("unit") == "D", 86400).when(F.col("unit") == "h", 3600).when(F.col("unit") == "min", 60).otherwise(1)


def future_time() -> Column:
    """Time of future `step` from `__n`, `__first`, `__last`: last + average step * i; month ends after a single point."""
    gap = "timestampdiff(MICROSECOND, __first, __last) / (__n - 1)"
    ahead = F.expr(f"__last + make_dt_interval(0, 0, 0, cast({gap} * step / 1e6 as decimal(18, 6)))")
    month_end = F.last_day(F.add_months("__last", F.col("step") - 1)).cast("timestamp_ntz")
    return F.when(F.col("__n") > 1, ahead).otherwise(month_end)


def future_bins(df: DataFrame, keys: list[str], steps: int, time: str = "time_bin") -> DataFrame:
    """The next `steps` bin times of every series."""
    span = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(time).alias("__first"), F.max(time).alias("__last")
    )
    rows = span.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return rows.select(*keys, "step", future_time().alias(time))


def directional_accuracy(df: DataFrame, keys: list[str], time: str = "time_bin") -> DataFrame:
    """Share of steps where actual and forecast both rise or both do not; 0.5 for a single point."""
    w = _by(keys).orderBy(time)
    same = (F.col("actual") > F.lag("actual").over(w)) == (F.col("forecast") > F.lag("forecast").over(w))
    return df.withColumn("__s", same.cast("double")).groupBy(*keys).agg(
        F.coalesce(F.avg("__s"), F.lit(0.5)).alias("directional_accuracy")
    )


def summary_report(probs: DataFrame, time: str = "time_bin") -> DataFrame:
    """Per category: mean probability over documents, trend, volatility, peak and trough of the bin means."""
    bins = settle(probs.groupBy("category", time).agg(
        F.avg("prob").alias("value"), F.sum("prob").alias("__s"), F.count(F.lit(1)).alias("__n")
    ))
    mean = bins.groupBy("category").agg((F.sum("__s") / F.sum("__n")).alias("mean_prob"))
    return (
        mean.join(trend(bins, ["category"], time).drop("intercept"), "category")
        .join(changes(bins, ["category"], time).select("category", "volatility"), "category")
        .join(peaks(bins, ["category"], time), "category")
    )
