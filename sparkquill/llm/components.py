"""Connected components of a large graph by alternating large-star and small-star steps.

Every step is an aggregation to minima and a join; each round is written to the shared folder, so a
lost executor costs a task and no lineage grows; the round before is then deleted. A hub's edges are
summed before the shuffle, and meet their minimum through a broadcast of the hubs alone. Nothing of the
graph reaches the driver but two sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquill.llm import tables
from sparkquill.session import discard, stored


def _joined(edges: DataFrame, least: DataFrame, name: str) -> DataFrame:
    """Edges with the minimum of their vertex; those of hubs meet it apart, if there are any."""
    least = stored(least, f"{name}-least", "lz4")
    if least.where(F.col("n") > tables.HOT_ROWS).limit(1).count():
        return tables.join_hot(edges, least, "u", "n")
    return edges.join(least.drop("n"), "u")


def _large_star(edges: DataFrame, name: str) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _joined(both.where(F.col("v") > F.col("u")), least, name).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, name: str) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _joined(down, least, name)
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of the edges (a, b); root is the least vertex of its component.

    Loops and repeated edges are allowed; an edge with a null end is none.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        out = stored(df.where(F.col("a") != F.col("b")).distinct(), name, "lz4")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())

    now, mark = written(edges.toDF("a", "b"))
    while mark[0]:
        before = now
        large = stored(_large_star(before, name).where(F.col("a") != F.col("b")).distinct(), f"{name}-large", "lz4")
        now, after = written(_small_star(large, name))
        discard(before)
        discard(large)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
