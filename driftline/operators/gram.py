"""Sums of products of lagged series: what every least-squares fit over the series of a corpus needs.

Rows are (corpus, time_bin, source, value). Sources are cut into blocks and bins into runs; each pair of blocks is multiplied run by run, so no
group holds more than `RUN` bins of two blocks, whatever the size of a corpus. Runs are added in the order of time, so results repeat to the bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

BLOCK = 32  # sources of a block
RUN = 64  # bins of a run


def lagged_gram(series: DataFrame, corpus: str, max_lags: int, lags: str = "lags", block: int = BLOCK) -> DataFrame:
    """(corpus, a, b, gram) for a <= b: the sums over all bins with `lags` predecessors of products of block a's with block b's columns.

    The columns of a block are its sources in order of name, each with its value and lags 1..lags; `gram` is that matrix row by row. `lags` is a
    column, constant within a corpus and up to `max_lags`. Every source has a value in every bin of its corpus.
    """
    time = Window.partitionBy(corpus, "source").orderBy("time_bin")
    names = series.select(corpus, "source").distinct()
    place = F.row_number().over(Window.partitionBy(corpus).orderBy("source")) - 1
    places = names.select(corpus, "source", F.floor(place / block).cast("int").alias("block"), (place % block).alias("place"))
    own = F.array("value", *[F.lag("value", i).over(time) for i in range(1, max_lags + 1)])
    rows = series.select(corpus, "source", "time_bin", F.slice(own, 1, F.col(lags) + 1).alias("z"), F.floor((F.row_number().over(time) - 1) / RUN).cast("int").alias("run"))
    rows = rows.where(F.element_at("z", -1).isNotNull()).join(places, [corpus, "source"])
    cells = rows.groupBy(corpus, "time_bin", "run", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "z"))), lambda p: p["z"])).alias("z"))
    left = cells.withColumnsRenamed({"block": "a", "z": "za"})
    right = cells.select(corpus, "time_bin", F.col("block").alias("b"), F.col("z").alias("zb"))
    pairs = left.join(right, [corpus, "time_bin"]).where("a <= b").select(corpus, "a", "b", "run", "time_bin", "za", "zb")

    def products(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("time_bin").combine_chunks()
        x, y = (rows.column(c).chunk(0).flatten().to_numpy().reshape(rows.num_rows, -1) for c in ("za", "zb"))
        keys = rows.select([corpus, "a", "b", "run"]).slice(0, 1)
        return keys.append_column("gram", pa.array([(x.T @ y).ravel()], pa.list_(pa.float64())))

    keys = [pairs.schema[c] for c in (corpus, "a", "b", "run")]
    parts = pairs.groupBy(corpus, "a", "b", "run").applyInArrow(products, StructType([*keys, StructField("gram", ArrayType(DoubleType()))]))
    runs = F.transform(F.array_sort(F.collect_list(F.struct("run", "gram"))), lambda p: p["gram"])
    total = F.aggregate(F.slice("runs", 2, F.size("runs")), F.col("runs")[0], lambda s, g: F.zip_with(s, g, lambda x, y: x + y))
    return parts.groupBy(corpus, "a", "b").agg(runs.alias("runs")).select(corpus, "a", "b", total.alias("gram"))


class Moments:
    """The sums of one corpus as a matrix: least squares of every source on the lags of all, without constant."""

    def __init__(self, blocks, sources: int, lags: int, bins: int, block: int = BLOCK):
        """`blocks` has (a, b, gram) of `lagged_gram`; `bins` is the number of bins summed."""
        self.k, self.p, self.n, width = sources, lags, bins, lags + 1
        self.sums = np.zeros((sources * width, sources * width))
        for a, b, gram in blocks:
            rows, cols = ((at * block * width, min((at + 1) * block, sources) * width) for at in (a, b))
            part = np.asarray(gram).reshape(rows[1] - rows[0], cols[1] - cols[0])
            self.sums[slice(*rows), slice(*cols)] = part
            self.sums[slice(*cols), slice(*rows)] = part.T
        self.width = width

    def fit(self, lags: int | None = None):
        """(inverse of X'X, coefficients, residual sums of products) of the model with the first `lags` lags; X is ordered by lag, then source."""
        p = lags or self.p
        at = [i * self.width + lag for lag in range(1, p + 1) for i in range(self.k)]
        now = [i * self.width for i in range(self.k)]
        xx, xy, yy = self.sums[np.ix_(at, at)], self.sums[np.ix_(at, now)], self.sums[np.ix_(now, now)]
        size = np.sqrt(np.diag(xx))
        scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)  # series of any size side by side
        inverse = scale[:, None] * np.linalg.pinv(scale[:, None] * xx * scale, hermitian=True) * scale
        coef = inverse @ xy
        return inverse, coef, yy - coef.T @ xy - xy.T @ coef + coef.T @ xx @ coef


def with_moments(series: DataFrame, corpus: str, max_lags: int, solve, schema: StructType, block: int = BLOCK) -> DataFrame:
    """Run `solve(names, moments)` once per corpus, on the sums alone; it returns an Arrow table of `schema` without the corpus column.

    `series` carries `lags` and `bins` (the corpus's number of bins), both constant within a corpus.
    """
    sums = lagged_gram(series, corpus, max_lags, block=block)
    meta = series.groupBy(corpus, "source").agg(F.first("lags").alias("lags"), F.first("bins").alias("bins"))
    meta = meta.groupBy(corpus).agg(F.array_sort(F.collect_list("source")).alias("names"), F.first("lags").alias("lags"), F.first("bins").alias("bins"))

    def run(blocks: pa.Table, about: pa.Table) -> pa.Table:
        tag = about.select([corpus])
        about = about.to_pylist()[0]
        rows = [(r["a"], r["b"], r["gram"]) for r in blocks.select(["a", "b", "gram"]).to_pylist()]
        moments = Moments(rows, len(about["names"]), about["lags"], about["bins"] - about["lags"], block)
        out = solve(about["names"], moments)
        return out.add_column(0, corpus, tag.column(0).combine_chunks().take(pa.array(np.zeros(out.num_rows, np.int64))))

    return sums.groupBy(corpus).cogroup(meta.groupBy(corpus)).applyInArrow(run, StructType([series.schema[corpus], *schema.fields]))

