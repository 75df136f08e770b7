"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (src, dst: longs).

    Large star links each node's larger neighbours to its smallest neighbour, small star links the smaller ones; both
    keep the components. Minima are partial aggregates and the joins have one row per node on one side, so a hub's
    links need not meet in one task. Each step is written out, so lost executors cost one step. The
    steps end when every node is linked to its root alone.
    """
    e = links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stored(e, "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # u > v everywhere: a node's smaller neighbours, and itself, go to the smallest of them.
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = stored(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        # Stars only: a node has one link, and no root is linked on.
        many = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if not many and not new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi").limit(1).count():
            finished(e)
            e = new
            break
        finished(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
