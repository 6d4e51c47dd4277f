"""Table sinks for series, edges and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str, by: str | None = "year", time: str = "time_bin", mode: str = "overwrite") -> None:
    """Parquet. Series are bin-level, so they are partitioned by calendar year (or month) of the bin, not by bin:
    date filters still skip folders and there is no folder with a handful of rows.

    A rebalancing shuffle gathers each folder's rows into files of the advisory size; a hot folder gets several.
    """
    if by is None:
        df.write.mode(mode).parquet(path)
        return
    folder = {"year": F.year(time), "month": F.date_format(time, "yyyy-MM")}[by]
    df.withColumn(by, folder).hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)
