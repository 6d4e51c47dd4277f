"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import freed_shuffles, settle

ROWS = 20_000  # links of a partition, while there are more cores than that takes


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in `links`; component is the smallest id that can be reached.

    Star contraction: all larger neighbours of a node are hung on its smallest neighbour, then all smaller ones. The
    depth of a component halves about every round, and a round is two grouped minima and two joins, whose partial
    sums and skew splitting cope with a node that has very many links. Every round is written to the shared folder. A few links, spread over
    all shuffle partitions, would be little more than tasks and files, so partitions are joined (a narrow step) to one a core or `ROWS` links each.
    Null ids and links of a node with itself are left out; an empty table gives an empty table.
    """
    edges = settle(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())
    state, size, cores = None, edges.count(), edges.sparkSession.sparkContext.defaultParallelism
    while True:
        parts = max(cores, -(-size // ROWS))
        edges = _star(edges.coalesce(parts), True, parts)
        edges = settle(_star(edges, False, parts))
        with freed_shuffles(edges.sparkSession):
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        size = now.n
        if now == state or not now.n:
            break
        state = now
    leaves = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return leaves.unionByName(roots)


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """One contraction; rows run from the larger id u to the smaller id v, in at most `parts` partitions."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").coalesce(parts).distinct().coalesce(parts)
