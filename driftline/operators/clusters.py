"""Topics and clustering quality.

Quality measures use per-cluster sums instead of pairs. A table of k cluster vectors is only ever sent to tasks in
slices of bounded size; more clusters mean more narrow passes, not a bigger broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.vectors import dot, doubles, norm, unit
from driftline.operators import lloyd
from driftline.operators.embedding import as_matrix, mean_vectors
from driftline.operators.neighbours import distance_sums
from driftline.operators.ranking import sample_rows
from driftline.session import lookup, packed, settle

SLICE_CELLS = 4_000_000  # numbers per broadcast slice: 32 MB
SAMPLE_ROWS = 2_000  # rows of a cluster that stand for it where distances have no closed form


def topic_count(rows: int, n_topics: int = 8) -> int:
    return min(n_topics, max(1, rows // 20))


def _vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return packed(settle(df.filter(F.col(vec).isNotNull()).select(id_col, doubles(vec).alias("v"))))


def _sample(rows: DataFrame, id_col: str, most: int) -> np.ndarray:
    """Vectors of at most `most` rows, chosen by hash: what starts are picked from."""
    return np.array([r["v"] for r in sample_rows(rows, most, id_col).select("v").collect()], dtype=float)


def assign_topics(df: DataFrame, id_col: str, vec: str = "embedding", n_topics: int = 8, restarts: int = 10,
                  seed: int = 42, start_rows: int = 5_000) -> DataFrame:
    """KMeans topics (id, topic): k = min(n_topics, max(1, n div 20)), the cheapest of several seeded starts.

    Starts are picked from a sample of `start_rows` rows; all of them are fitted to all rows, in the same scans.
    """
    rows = _vectors(df, id_col, vec)
    n = rows.count()
    k = topic_count(n, n_topics)
    if k < 2:
        return rows.select(id_col, F.lit(0).alias("topic"))
    sample = _sample(rows, id_col, start_rows)
    fits = lloyd.fit_many(rows, "v", [lloyd.spread_starts(sample, k, seed + i) for i in range(restarts)])
    return lloyd.assigned(rows, id_col, "v", min(fits, key=lambda f: f.cost).centres, "topic")


def topic_sizes(assigned: DataFrame, topic: str = "topic") -> DataFrame:
    """Non-empty topics and their sizes."""
    return assigned.groupBy(F.col(topic).alias("topic_id")).agg(F.count(F.lit(1)).alias("size"))


def choose_k(df: DataFrame, id_col: str, vec: str = "embedding", ks: tuple[int, ...] = tuple(range(2, 21)), seed: int = 42,
             start_rows: int = 5_000) -> DataFrame:
    """Silhouette and inertia for every k; the best silhouette is marked. All k are fitted, and judged, in the same scans."""
    rows = _vectors(df, id_col, vec)
    sample = _sample(rows, id_col, start_rows)
    found = []
    if len(sample):
        fits = lloyd.fit_many(rows, "v", [lloyd.spread_starts(sample, k, seed) for k in ks])
        found = list(zip(ks, lloyd.silhouettes(rows, "v", fits), [f.cost for f in fits]))
    best = max((r for r in found if r[1] is not None), key=lambda r: (r[1], -r[0]), default=(None,))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in found], "k int, silhouette double, inertia double, best boolean")


def cluster_balance(df: DataFrame, label: str) -> DataFrame:
    """Size and share of each cluster, and the entropy of the shares over ln k."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(F.lit(0))  # over clusters, not rows
    p = F.col("size") / F.sum("size").over(whole)
    out = sizes.withColumn("share", p)
    entropy = -F.sum(F.col("share") * F.log(F.col("share") + F.lit(1e-10))).over(whole)
    return out.withColumn("balance", F.try_divide(entropy, F.log(F.count(F.lit(1)).over(whole))))


def contingency(df: DataFrame, cluster: str, label: str) -> DataFrame:
    return df.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))


def _margins(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Contingency cells with row, column and grand totals, from the aggregated table."""
    cells = settle(contingency(df.filter(F.col(cluster).isNotNull() & F.col(label).isNotNull()), cluster, label))
    rows = cells.groupBy(cluster).agg(F.sum("n").alias("a"))
    cols = cells.groupBy(label).agg(F.sum("n").alias("b"))
    total = cells.agg(F.sum("n")).scalar()
    return cells.join(rows, cluster).join(cols, label).withColumn("total", total)


def label_agreement_scores(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic mean), majority purity and (NMI + purity) / 2."""
    cells = _margins(df, cluster, label).select("*", F.col(cluster).alias("__c"), F.col(label).alias("__l"))

    def pairs(c):
        x = F.col(c).cast("double")
        return x * (x - 1) / 2

    n = F.col("total").cast("double")
    info = F.col("n") / n * F.log(n * F.col("n") / (F.col("a").cast("double") * F.col("b")))
    whole = cells.agg(F.sum(pairs("n")).alias("cells2"), F.sum(info).alias("mi"), F.max("total").alias("total"))
    by_cluster = cells.groupBy("__c").agg(F.max("n").alias("top"), F.max("a").alias("a"), F.max("total").alias("total"))
    by_label = cells.groupBy("__l").agg(F.max("b").alias("b"), F.max("total").alias("total"))
    rows = by_cluster.agg(
        F.sum(pairs("a")).alias("rows2"), F.sum("top").alias("top"),
        (-F.sum(F.col("a") / n * F.log(F.col("a") / n))).alias("h1"))
    cols = by_label.agg(F.sum(pairs("b")).alias("cols2"), (-F.sum(F.col("b") / n * F.log(F.col("b") / n))).alias("h2"))
    # Three one-row tables side by side.
    one = whole.withColumn("__k", F.lit(1)).join(rows.withColumn("__k", F.lit(1)), "__k").join(cols.withColumn("__k", F.lit(1)), "__k")
    expected = F.coalesce(F.try_divide(F.col("rows2") * F.col("cols2"), pairs("total")), F.lit(0.0))
    top = (F.col("rows2") + F.col("cols2")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("cells2") - expected) / F.when(top != expected, top - expected))
    mean_h = (F.col("h1") + F.col("h2")) / 2
    nmi = F.when(mean_h <= 1e-15, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("mi")) / F.when(mean_h > 1e-15, mean_h))
    purity = F.col("top") / F.col("total")
    return one.select(ari.alias("ari"), nmi.alias("nmi"), purity.alias("purity"), ((nmi + purity) / 2).alias("score"))


def cluster_sums(df: DataFrame, label: str, vec: str, scaled: bool) -> DataFrame:
    """Rows, vector sum and squared-norm sum per cluster."""
    v = unit(vec) if scaled else doubles(vec)
    rows = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), v.alias("v"))
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("s"),
        F.sum(dot("v", "v")).alias("q"),
    )


def _slices(table: DataFrame, vec: str, key: str) -> Iterator[list]:
    """The table's rows in pieces of at most about SLICE_CELLS numbers, each brought to the driver on its own."""
    size = table.agg(F.count(F.lit(1)).alias("k"), F.max(F.size(vec)).alias("d")).first()
    pieces = max(1, math.ceil(size["k"] * (size["d"] or 1) / SLICE_CELLS))
    if pieces == 1:
        yield table.collect()
        return
    for i in range(pieces):
        yield table.filter(F.pmod(F.xxhash64(key), F.lit(pieces)) == i).collect()


def _against(df: DataFrame, table: DataFrame, vec: str, key: str, score: Callable, schema: str) -> tuple[DataFrame, int]:
    """Apply score(record_batch, slice_rows) for every slice of a settled table; united results and number of slices."""
    sc = df.sparkSession.sparkContext
    parts = []
    for rows in _slices(table, vec, key):
        if not rows:
            continue
        sent = sc.broadcast(rows)

        step = max(1, SLICE_CELLS // len(rows))  # keeps the rows-by-clusters matrix at 32 MB too

        def run(batches, sent=sent, step=step):
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    yield score(batch.slice(lo, step), sent.value)

        parts.append(df.mapInArrow(run, schema))
    if not parts:
        return df.sparkSession.createDataFrame([], schema), 0
    return reduce(DataFrame.unionByName, parts), len(parts)


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def silhouette_samples(df: DataFrame, id_col: str, label: str, vec: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Silhouette of every row: (id, label, silhouette).

    `cosine` and `sqeuclidean` come from cluster sums in work linear in the rows. `euclidean` has no such form: mean distances are taken from a
    sample of every cluster (all of it up to `SAMPLE_ROWS` rows, so small clusters are exact); `euclidean_exact` goes through blocked
    distance sums of all pairs. Rows alone in their cluster get 0.
    """
    if metric == "euclidean_exact":
        return _silhouette_blocks(df, id_col, label, vec)
    if metric == "euclidean":
        return sampled_silhouettes(df, id_col, label, vec).drop("error")
    scaled = metric == "cosine"
    table = settle(cluster_sums(df, label, vec, scaled))
    rows = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).alias("v"))

    def score(batch, found):
        x = as_matrix(batch.column("v"))
        if scaled:
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        n = np.array([r["n"] for r in found], dtype=float)
        s = np.array([r["s"] for r in found])
        q = np.array([r["q"] for r in found])
        own_q = (x**2).sum(axis=1)[:, None]
        inner = x @ s.T
        total = n - inner if scaled else n * own_q - 2 * inner + q
        names = pa.array([str(r["label"]) for r in found])
        at = pc.index_in(batch.column("label"), value_set=names).to_numpy(zero_copy_only=False).astype(float)
        mine = ~np.isnan(at)
        where = np.where(mine, at, 0).astype(int)
        line = np.arange(len(x))
        # The pair of a row with itself is at distance 0, except that a zero vector counts 1 under cosine.
        self_pair = 1 - own_q[:, 0] if scaled else 0.0
        with np.errstate(all="ignore"):
            a = np.where(mine, (total[line, where] - self_pair) / (n[where] - 1), np.nan)
            mean = total / n
        mean[line[mine], where[mine]] = np.inf
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(a, from_pandas=True),
             pa.array(np.where(mine, n[where], np.nan), from_pandas=True), pa.array(mean.min(axis=1))],
            names=["id", "label", "a", "n", "b"])

    parts, slices = _against(rows, table, "s", "label", score, f"id {id_type(df, id_col)}, label string, a double, n double, b double")
    if slices > 1:
        parts = parts.groupBy("id", "label").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("b").alias("b"))
    return _silhouette_of(parts)


def _silhouette_of(parts: DataFrame, *more: Column) -> DataFrame:
    top = F.greatest("a", "b")
    s = F.when((F.col("n") < 2) | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return parts.select("id", "label", s.alias("silhouette"), *more)


def sampled_silhouettes(df: DataFrame, id_col: str, label: str, vec: str = "embedding", per_cluster: int | None = None) -> DataFrame:
    """Euclidean silhouette of every row from about `per_cluster` rows of each cluster, chosen by hash: (id, label, silhouette, error).

    `error` bounds the error of a row's value to first order: three standard errors of both mean distances, without replacement, over the
    larger one; 0 where whole clusters were taken. Its mean bounds the error of the mean silhouette.
    """
    per_cluster = per_cluster or SAMPLE_ROWS
    rows = df.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.col(vec).alias("v"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    dice = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(lookup(sizes), "label").withColumn("inside", (dice * F.col("n") < per_cluster).cast("int"))
    table = settle(rows.filter("inside = 1").select("label", "n", doubles("v").alias("s")))

    def score(batch, found):
        x = as_matrix(batch.column("v"))
        names = sorted({r["label"] for r in found})
        code = {c: k for k, c in enumerate(names)}
        member = np.zeros((len(found), len(names)))
        member[np.arange(len(found)), [code[r["label"]] for r in found]] = 1.0
        size = {r["label"]: r["n"] for r in found}
        n, m = np.array([size[c] for c in names], float), member.sum(0)
        y = np.array([r["s"] for r in found])
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0.0))
        total, squares = d @ member, d**2 @ member
        at = pc.index_in(batch.column("label"), value_set=pa.array(names)).to_numpy(zero_copy_only=False).astype(float)
        mine, where, line = ~np.isnan(at), np.where(np.isnan(at), 0, at).astype(int), np.arange(len(x))
        taken, whole = np.tile(m, (len(x), 1)), np.tile(n, (len(x), 1))
        taken[line[mine], where[mine]] -= batch.column("inside").to_numpy()[mine]  # a row is not its own neighbour
        whole[line[mine], where[mine]] -= 1
        with np.errstate(all="ignore"):
            mean = total / taken
            spread = np.maximum(squares / taken - mean**2, 0.0) * taken / np.maximum(taken - 1, 1)
            error = 3 * np.sqrt(spread / taken * np.maximum(1 - taken / whole, 0.0))
        a, a_error = (np.where(mine & (taken[line, where] > 0), v[line, where], np.nan) for v in (mean, error))
        mean[line[mine], where[mine]] = np.inf
        mean[~np.isfinite(mean)] = np.inf
        best = mean.argmin(axis=1)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(a, from_pandas=True), pa.array(a_error, from_pandas=True), pa.array(np.where(mine, n[where], np.nan), from_pandas=True),
             pa.array(mean[line, best]), pa.array(np.where(np.isfinite(mean[line, best]), error[line, best], 0.0))], names=["id", "label", "a", "ea", "n", "b", "eb"])

    schema = f"id {id_type(df, id_col)}, label string, a double, ea double, n double, b double, eb double"
    parts, _ = _against(rows, table, "s", "label", score, schema)
    best = parts.groupBy("id", "label").agg(F.max("a").alias("a"), F.max("ea").alias("ea"), F.max("n").alias("n"), F.min(F.struct("b", "eb")).alias("o"))
    best = best.select("id", "label", "a", "ea", "n", F.col("o.b").alias("b"), F.col("o.eb").alias("eb"))
    error = F.when((F.col("n") < 2) | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("ea") + F.col("eb")) / F.greatest("a", "b"))
    return _silhouette_of(best, error.alias("error"))


def _silhouette_blocks(df: DataFrame, id_col: str, label: str, vec: str) -> DataFrame:
    sums = distance_sums(df, id_col, label, vec)
    own = df.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("own"))
    rows = sums.join(own, "id").withColumn("mine", F.col("label") == F.col("own"))
    parts = rows.groupBy("id", F.col("own").alias("label")).agg(
        F.max(F.when(F.col("mine"), F.col("total") / F.when(F.col("rows") > 1, F.col("rows") - 1))).alias("a"),
        F.max(F.when(F.col("mine"), F.col("rows"))).alias("n"),
        F.min(F.when(~F.col("mine"), F.col("total") / F.col("rows"))).alias("b"),
    )
    return _silhouette_of(parts)


def silhouette(df: DataFrame, id_col: str, label: str, vec: str = "embedding", metric: str = "cosine", min_rows: int = 10, compat: bool = False) -> DataFrame:
    """Mean silhouette; null when there are not 2 to n - 1 clusters. `compat` gives 0 there and below `min_rows` rows."""
    s = silhouette_samples(df, id_col, label, vec, metric).groupBy("label").agg(
        F.sum("silhouette").alias("s"), F.count(F.lit(1)).alias("n"))
    k, n = F.count(F.lit(1)), F.sum("n")
    undefined = F.coalesce((k < 2) | (k > n - 1), F.lit(True))
    mean = F.when(~undefined, F.sum("s") / n)
    return s.agg((F.when(undefined | (n < min_rows), 0.0).otherwise(mean) if compat else mean).alias("silhouette"))


def davies_bouldin(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij, s being the mean distance to the own centroid."""
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(label).cast("string").alias("label"), doubles(vec).alias("v"))
    centers = mean_vectors(rows, ["label"], "v", "c").select("label", "c")
    gap = norm(F.zip_with("v", "c", lambda x, y: x - y))
    spread = rows.join(lookup(centers), "label").groupBy("label").agg(F.avg(gap).alias("s"))
    table = settle(centers.join(spread, "label"))

    def worst(batch, found):
        c, s = as_matrix(batch.column("c")), batch.column("s").to_numpy(zero_copy_only=False)
        oc, os = np.array([r["c"] for r in found]), np.array([r["s"] for r in found])
        d = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (oc**2).sum(1)[None] - 2 * c @ oc.T, 0.0))
        other = np.array(batch.column("label").to_pylist(), dtype=object)[:, None] != np.array([r["label"] for r in found], dtype=object)[None]
        with np.errstate(all="ignore"):
            ratio = np.where(other & (d > 0), (s[:, None] + os[None]) / d, 0.0)
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ratio.max(axis=1))], names=["label", "r"])

    worst_of, _ = _against(table, table, "c", "label", worst, "label string, r double")
    return worst_of.groupBy("label").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """(between / (k - 1)) / (within / (n - k)) from one aggregate per cluster; null where undefined."""
    sums = cluster_sums(df, label, vec, False)
    part = dot("s", "s") / F.col("n")
    one = sums.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum(part).alias("p"),
        vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"),
    )
    between, within = F.col("p") - dot("s", "s") / F.col("n"), F.col("q") - F.col("p")
    score = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return one.select(score.alias("calinski_harabasz"))


def nearest_centroid(df: DataFrame, centers: DataFrame, id_col: str, cluster: str, center_vec: str, vec: str = "embedding") -> DataFrame:
    """Closest centroid (Euclidean) of every row: (id, cluster, distance); ties go to the smaller cluster."""
    table = settle(centers.select(F.col(cluster).cast("string").alias("k"), F.col(center_vec).alias("c")))
    rows = df.filter(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))

    def score(batch, found):
        found = sorted(found, key=lambda r: r["k"])
        x, c = as_matrix(batch.column("v")), np.array([r["c"] for r in found], dtype=float)
        d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0.0)
        best = np.round(d, 9).argmin(axis=1)
        names = pa.array([r["k"] for r in found])
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), names.take(pa.array(best)), pa.array(np.sqrt(d[np.arange(len(x)), best]))], names=["id", "k", "d"])

    parts, _ = _against(rows, table, "c", "k", score, f"id {id_type(df, id_col)}, k string, d double")
    best = parts.groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("r"), "k", "d")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("b.k").alias(cluster), F.col("b.d").alias("distance"))


def embedding_score(silhouettes: DataFrame) -> DataFrame:
    """Silhouette mapped from [-1, 1] to [0, 1]."""
    return silhouettes.select(((F.col("silhouette") + 1) / 2).alias("score"))
