"""Granger-style influence between the source series of a corpus.

Input is the long matrix (keys..., time_bin, source, value): dense bins, gaps filled. `keys` separate corpora, which
are tested in parallel. The joint model is fitted from sums of products (`gram`), which all tasks share; what a corpus brings
together is one matrix. A joint model of k sources at p lags needs more than (k + 1) * p bins, so that matrix is bounded by
the square of the calendar; larger ones are settled by the guard without leaving the JVM.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from driftline.functions.stats import clamp_f, clamp_p, f_sf, f_tail_even
from driftline.operators.gram import Moments, with_moments
from driftline.session import settle

MIN_BINS = 10  # fixed value: fewer bins are never tested
MOST_LAGS = 4  # fixed value
ALL = "__corpus"


def _tagged(matrix: DataFrame, keys: list[str]) -> DataFrame:
    return matrix.withColumn(ALL, F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))


def _untag(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != ALL]
    return df.select(*[F.col(f"{ALL}.{k}").alias(k) for k in keys], *rest)


def causal_guard(matrix: DataFrame, keys: list[str] | None = None, lags: int | None = None) -> DataFrame:
    """Per corpus: sources, bins, lag order, residual degrees of freedom and whether the joint test can run."""
    return _untag(_guard(_tagged(matrix, keys or []), lags), keys or [])


def _guard(tagged: DataFrame, fixed: int | None = None) -> DataFrame:
    # Bins and sources first, so no distinct count holds more than one corpus's calendar or source list per key.
    by_bin = tagged.groupBy(ALL, "time_bin").agg(F.count(F.lit(1)).alias("__w"))
    bins = by_bin.groupBy(ALL).agg(F.count(F.lit(1)).alias("bins"))
    names = tagged.groupBy(ALL, "source").agg(F.count(F.lit(1)).alias("__w")).groupBy(ALL).agg(
        F.count(F.lit(1)).alias("sources"))
    out = names.join(bins, ALL)
    lags = F.lit(fixed) if fixed else F.least(F.lit(MOST_LAGS), F.greatest(F.lit(1), F.floor((F.col("bins") - 1) / 3))).cast("int")
    out = out.withColumn("lags", lags).withColumn("df", F.col("bins") - F.col("lags") - F.col("sources") * F.col("lags"))
    status = (
        F.when(F.col("sources") < 2, "one_source").when(F.col("bins") < MIN_BINS, "too_few_bins")
        .when(F.col("df") <= 0, "too_many_sources").otherwise("tested")
    )
    return out.withColumn("status", status)


def ordered_pairs(matrix: DataFrame, keys: list[str] | None = None, salts: int = 32) -> DataFrame:
    """Every (cause, effect) of different sources in the same corpus; this is the shape of the result matrix.

    Rows are one per edge. The cause side is salted so that one corpus with many sources is spread over tasks.
    """
    keys = keys or []
    names = _tagged(matrix, keys).select(ALL, "source").distinct()
    left = names.select(ALL, F.col("source").alias("cause"), F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int").alias("__s"))
    right = names.select(ALL, F.col("source").alias("effect"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__s"))
    return _untag(left.join(right, [ALL, "__s"]).filter("cause <> effect").drop("__s"), keys)


def lag_design(matrix: DataFrame, lags: int, keys: list[str] | None = None) -> DataFrame:
    """Each source value with its own lags 1..`lags`; rows without all lags are dropped."""
    w = Window.partitionBy(*(keys or []), "source").orderBy("time_bin")
    out = matrix.select("*", *[F.lag("value", i).over(w).alias(f"lag{i}") for i in range(1, lags + 1)])
    return out.filter(F.col(f"lag{lags}").isNotNull())


def _noise(name: str, n: int) -> np.ndarray:
    seed = int(hashlib.md5(str(name).encode()).hexdigest()[:8], 16)
    return np.random.default_rng(seed).normal(0.0, 1e-6, n)


def _noisy(series: DataFrame) -> DataFrame:
    """Give a constant series tiny noise that depends only on its name."""
    own = Window.partitionBy(ALL, "source")
    rows = series.withColumns({"__sd": F.stddev_samp("value").over(own), "__at": F.row_number().over(own.orderBy("time_bin")) - 1})

    @F.pandas_udf("double")
    def noise(name: pd.Series, at: pd.Series) -> pd.Series:
        drawn = {n: _noise(n, int(at[name == n].max()) + 1) for n in name.unique()}
        return pd.Series([drawn[n][i] for n, i in zip(name, at, strict=True)], dtype=float)

    flat = F.coalesce(F.col("__sd") < 1e-10, F.lit(False))
    constant = rows.where(flat).withColumn("value", F.col("value") + noise("source", "__at"))
    return rows.where(~flat).unionByName(constant).drop("__sd", "__at")


EDGES = StructType([StructField("cause", StringType()), StructField("effect", StringType()), StructField("p_value", DoubleType()),
                    StructField("f_statistic", DoubleType()), StructField("lags", IntegerType())])


def _joint_test(names: list[str], moments: Moments) -> pa.Table:
    k, p = moments.k, moments.p
    df = moments.n - k * p
    inverse, coef, residual = moments.fit()
    s2 = np.diag(residual) / df
    rows = []
    for i, cause in enumerate(names):
        at = [lag * k + i for lag in range(p)]
        mid = np.linalg.pinv(inverse[np.ix_(at, at)], hermitian=True)
        with np.errstate(all="ignore"):
            f = ((coef[at].T @ mid) * coef[at].T).sum(axis=1) / p / s2  # of all effects
        rows += [(cause, effect, f[j]) for j, effect in enumerate(names) if i != j]
    f = np.array([r[2] for r in rows])
    pv = f_sf(f, p, k * df)
    bad = ~np.isfinite(pv) | ~np.isfinite(f)
    return pa.table([[r[0] for r in rows], [r[1] for r in rows], np.where(bad, 1.0, pv), np.where(bad, 0.0, f), pa.array([p] * len(rows), pa.int32())], EDGES.names)


def _split(matrix: DataFrame, keys: list[str], lags: int | None = None):
    tagged = _tagged(settle(matrix), keys)  # one row per bin and source, read several times
    marked = tagged.join(_guard(tagged, lags).select(ALL, "lags", "bins", "status"), ALL)
    ready = marked.filter("status = 'tested'").select(ALL, "time_bin", F.col("source").cast("string"), F.col("value").cast("double"), "lags", "bins")
    return marked.drop("bins"), _noisy(ready)


def granger_joint(matrix: DataFrame, keys: list[str] | None = None, lags: int | None = None) -> DataFrame:
    """F test of every ordered pair in one joint VAR(p) without constant, p = min(4, max(1, (T - 1) div 3)) or `lags`.

    Corpora the guard rejects give p = 1 and F = 0 for every pair, as does a failed test; `status` tells them from tests
    that found no influence.
    """
    keys = keys or []
    marked, ready = _split(matrix, keys, lags)
    tested = with_moments(ready, ALL, lags or MOST_LAGS, _joint_test, EDGES).withColumn("status", F.lit("tested"))
    rejected = marked.filter("status <> 'tested'").withColumnRenamed(ALL, "__tag")
    blank = ordered_pairs(rejected, ["__tag", "lags", "status"]).select(
        F.col("__tag").alias(ALL), F.col("cause").cast("string"), F.col("effect").cast("string"), F.lit(1.0).alias("p_value"),
        F.lit(0.0).alias("f_statistic"), F.col("lags").cast("int"), "status",
    )
    return _untag(tested.unionByName(blank), keys)


def granger_lag1(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bivariate lag-1 exclusion F (no constant) of every ordered pair in closed form from six sums; no Python.

    Each source is one row holding its aligned value and lag arrays (as long as the calendar); pairs are joined by
    source name, so the largest intermediate has one row per edge.
    """
    keys = keys or []
    matrix = settle(matrix)  # one row per bin and source, read several times
    lagged = lag_design(matrix, 1, keys)
    arrays = lagged.groupBy(*keys, "source").agg(
        F.array_sort(F.collect_list(F.struct("time_bin", "value", "lag1"))).alias("s"))
    effect = arrays.select(*keys, F.col("source").alias("effect"), F.col("s").alias("ys"))
    cause = arrays.select(*keys, F.col("source").alias("cause"), F.transform("s", lambda r: r["lag1"]).alias("xs"))
    rows = ordered_pairs(matrix, keys).join(effect, [*keys, "effect"]).join(cause, [*keys, "cause"])

    def total(expr):
        return F.aggregate(expr, F.lit(0.0), lambda a, v: a + v)

    def over_y(fn):
        return total(F.transform("ys", fn))

    rows = rows.select(
        *keys, "cause", "effect", F.size("ys").alias("n"),
        over_y(lambda r: r["value"] * r["value"]).alias("yy"), over_y(lambda r: r["lag1"] * r["lag1"]).alias("aa"),
        over_y(lambda r: r["value"] * r["lag1"]).alias("ya"), total(F.transform("xs", lambda x: x * x)).alias("xx"),
        total(F.zip_with("ys", "xs", lambda r, x: r["value"] * x)).alias("yx"),
        total(F.zip_with("ys", "xs", lambda r, x: r["lag1"] * x)).alias("ax"),
    )
    det = F.expr("aa * xx - ax * ax")
    restricted = F.expr("yy - try_divide(ya * ya, aa)")
    b = F.try_divide(F.expr("ya * xx - yx * ax"), det)
    c = F.try_divide(F.expr("yx * aa - ya * ax"), det)
    full = F.col("yy") - b * F.col("ya") - c * F.col("yx")
    f = F.try_divide((restricted - full) * (F.col("n") - 2), full)
    return rows.select(*keys, "cause", "effect", "n", F.when((det != 0) & (full > 0) & (F.col("n") > 2), f).alias("f_statistic"))


def _edge_arrays(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ordered pair with both sources' values in time order (constant series with their noise)."""
    arrays = matrix.groupBy(*keys, "source").agg(F.array_sort(F.collect_list(F.struct("time_bin", "value"))).alias("s"))
    values = F.transform("s", lambda p: p["value"].cast("double"))
    effect, cause = (arrays.select(*keys, F.col("source").alias(c), values.alias(v)) for c, v in (("effect", "ys"), ("cause", "xs")))
    return ordered_pairs(matrix, keys).join(effect, [*keys, "effect"]).join(cause, [*keys, "cause"])


def _best_lag(y: np.ndarray, x: np.ndarray, max_lags: int) -> tuple[float, float, int]:
    best = (1.0, 0.0, 0)
    for p in range(1, max_lags + 1):
        n = len(y) - p
        df = n - 2 * p - 1
        if df <= 0:
            break
        own = np.column_stack([np.ones(n), *[y[p - k : len(y) - k] for k in range(1, p + 1)]])
        both = np.column_stack([own, *[x[p - k : len(x) - k] for k in range(1, p + 1)]])
        target = y[p:]
        ssr = [((target - d @ np.linalg.lstsq(d, target, rcond=None)[0]) ** 2).sum() for d in (own, both)]
        if ssr[1] <= 0:
            continue
        f = (ssr[0] - ssr[1]) / p / (ssr[1] / df)
        pv = float(f_sf(np.array([f]), p, df)[0])
        if f >= 0 and np.isfinite(pv) and pv < best[0]:
            best = (pv, float(f), p)
    return best


def granger_pairwise(matrix: DataFrame, max_lags: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Two-series tests with a constant at lags 1..max_lags of every ordered pair of every corpus; the lag with the
    smallest p-value is reported.

    One row per edge holds the two series, so edges are tested in Arrow batches wherever they lie. Pairs with too few
    common bins for lag 1 have p = 1, F = 0, lag 0 and status too_few_bins.
    """
    keys = keys or []
    rows = _edge_arrays(settle(matrix), keys).select(*keys, F.col("cause").cast("string"), F.col("effect").cast("string"), "ys", "xs")

    def run(frames):
        for pdf in frames:
            out = []
            for cause, effect, ys, xs in zip(pdf["cause"], pdf["effect"], pdf["ys"], pdf["xs"], strict=True):
                pair = [np.asarray(v, float) for v in (ys, xs)]
                pair = [v + _noise(name, len(v)) if len(v) > 1 and v.std(ddof=1) < 1e-10 else v for v, name in zip(pair, (effect, cause), strict=True)]
                n = min(len(v) for v in pair)
                out.append((*_best_lag(pair[0][:n], pair[1][:n], max_lags), "tested" if n > 4 else "too_few_bins"))
            done = pd.DataFrame(out, columns=["p_value", "f_statistic", "lags", "status"], index=pdf.index)
            yield pd.concat([pdf[[*keys, "cause", "effect"]], done], axis=1)

    schema = StructType([*[rows.schema[k] for k in keys], StructField("cause", StringType()), StructField("effect", StringType()), StructField("p_value", DoubleType()),
                         StructField("f_statistic", DoubleType()), StructField("lags", IntegerType()), StructField("status", StringType())])
    return rows.mapInPandas(run, schema)


def granger_summary(edges: DataFrame, alpha: float = 0.10) -> DataFrame:
    """Edges with usable p and F, a Yes/No verdict and confidence in percent."""
    p, f = clamp_p(F.col("p_value")), clamp_f(F.col("f_statistic"))
    out = edges.withColumn("p_value", p).withColumn("f_statistic", f)
    out = out.withColumn("significant", F.when(F.col("p_value") < alpha, "Yes").otherwise("No"))
    return out.withColumn("confidence", (1 - F.col("p_value")) * 100)


def strongest_edges(summary: DataFrame, n: int = 20) -> DataFrame:
    """The report's n most significant edges."""
    return summary.orderBy("p_value", "cause", "effect").limit(n)


def causal_edges(summary: DataFrame, alpha: float = 0.10, min_weight: float = 0.0) -> DataFrame:
    """Graph edges: p below alpha and weight 1 - p of at least `min_weight`."""
    weight = 1 - F.col("p_value")
    return summary.filter((F.col("p_value") < alpha) & (weight >= min_weight)).withColumn("weight", weight)


def matrix_summary(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Min, mean and max p and max F of the square matrix; its diagonal has p = 0 and F = 0."""
    keys = keys or []
    effects = edges.groupBy(*keys, "effect").agg(
        F.min("p_value").alias("lo"), F.max("p_value").alias("hi"), F.sum("p_value").alias("s"),
        F.max("f_statistic").alias("f"), F.count(F.lit(1)).alias("c"),
    )
    return effects.groupBy(*keys).agg(
        F.least(F.min("lo"), F.lit(0.0)).alias("min_p"), (F.sum("s") / (F.sum("c") + F.count(F.lit(1)))).alias("mean_p"),
        F.max("hi").alias("max_p"), F.greatest(F.max("f"), F.lit(0.0)).alias("max_f"),
    )


def causal_confidence(bins: DataFrame, col: str = "bins") -> DataFrame:
    """Confidence from the number of bins: bins / 50 held to [0.1, 0.9], and the stepped 5/10/20 scale."""
    n = F.col(col)
    smooth = F.least(F.lit(0.9), F.greatest(F.lit(0.1), n / 50))
    stepped = F.when(n < 5, 0.1).when(n < 10, 0.3).when(n < 20, 0.6).otherwise(0.85)
    return bins.withColumn("confidence", smooth).withColumn("stepped_confidence", stepped)


def impulse_response(matrix: DataFrame, horizon: int = 10, keys: list[str] | None = None, lags: int | None = None) -> DataFrame:
    """Response of every source to a unit shock in every source over `horizon` steps of the joint model.

    Corpora the guard rejects give one row with nulls and their status.
    """
    keys = keys or []
    marked, ready = _split(matrix, keys, lags)
    schema = StructType([StructField("cause", StringType()), StructField("effect", StringType()), StructField("step", IntegerType()), StructField("response", DoubleType())])

    def run(names: list[str], moments: Moments) -> pa.Table:
        k, p = moments.k, moments.p
        coef = moments.fit()[1]
        mats = [coef[i * k : (i + 1) * k].T for i in range(p)]
        phi = [np.eye(k)]
        for h in range(1, horizon + 1):
            phi.append(sum(mats[i] @ phi[h - 1 - i] for i in range(min(p, h))))
        rows = [(c, e, h, float(phi[h][j, i])) for h in range(horizon + 1) for i, c in enumerate(names) for j, e in enumerate(names)]
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)], schema.names)

    tested = with_moments(ready, ALL, lags or MOST_LAGS, run, schema).withColumn("status", F.lit("tested"))
    return _untag(tested.unionByName(_rejected(marked), allowMissingColumns=True), keys)


def _rejected(marked: DataFrame) -> DataFrame:
    return marked.filter("status <> 'tested'").select(ALL, "status").distinct()


def lag_order(matrix: DataFrame, max_lags: int = 4, keys: list[str] | None = None) -> DataFrame:
    """AIC of the joint model at lags 1..max_lags on a common sample; the best is marked. All lags come from the same sums.

    Corpora the guard rejects give one row with nulls and their status.
    """
    keys = keys or []
    marked, ready = _split(matrix, keys)
    schema = StructType([StructField("lag", IntegerType()), StructField("aic", DoubleType())])

    def run(_, moments: Moments) -> pa.Table:
        n, k, found = moments.n, moments.k, []
        for p in range(1, max_lags + 1):
            sign, logdet = np.linalg.slogdet(moments.fit(p)[2] / n) if n > k * p else (0, 0.0)
            found.append(float(logdet + 2.0 / n * p * k * k) if sign > 0 else None)
        return pa.table([pa.array(range(1, max_lags + 1), pa.int32()), pa.array(found, pa.float64())], schema.names)

    # The sample must hold every lag: a corpus of fewer bins has no usable order.
    long = ready.where(F.col("bins") > max_lags).withColumn("lags", F.lit(max_lags))
    short = ready.where(F.col("bins") <= max_lags).select(ALL).distinct().withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lags))))
    out = with_moments(long, ALL, max_lags, run, schema).unionByName(short, allowMissingColumns=True)
    best = F.min(F.when(F.col("aic").isNotNull(), F.struct("aic", "lag"))).over(Window.partitionBy(ALL))
    out = out.withColumn("best", F.col("lag") == best["lag"]).withColumn("status", F.lit("tested"))
    return _untag(out.unionByName(_rejected(marked), allowMissingColumns=True), keys)


def joint_p_closed(f: str, k: str, df: str):
    """p-value of the lag-4 joint test as a plain expression."""
    return f_tail_even(F.col(f), 4, F.col(k) * F.col(df))
