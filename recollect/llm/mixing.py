"""Mixing sources to target weights by Efraimidis-Spirakis sampling [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Cells of the sampling key; only one cell of each source is ever sorted.
CELLS = 65536


def n_words(text: Column) -> Column:
    """Number of words between white space; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of each source.

    sizes: source, source_size. Sources in order of code points, null last, get the weights in turn and
    share the sum of all sizes; a target stops at repeats times its source's size and the excess goes to the
    others by weight until none is above. With ratio r = repeats * size / weight, the sources that stop are
    the first in order of r: source k stops if r_k times the weight not yet stopped is at most what is left.
    So one running sum by r gives the end of the resharing at once.
    """
    one = F.lit(1)  # one row per source
    order = Window.partitionBy(one).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rank = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank + 1).cast("int")))
    w = w.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    by_ratio = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(one)
    w = (
        w.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.col("free") <= F.col("left") * F.col("weight"))
    )
    # Once a source is not full none after it is.
    w = w.withColumn("open", F.max(~F.col("full")).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("left") / F.col("free")).alias("x"))).over(everything)
    w = w.withColumn("share", share)
    target = F.when(F.col("open"), F.col("share.col2") * F.col("weight")).otherwise(F.col("cap"))
    return w.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, repeats: int = REPEATS, cells: int = CELLS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs, and source.

    A source's target is target // source_size complete epochs of all its documents, then a weighted sample
    without replacement: document keys u ** (1 / w), u a hash of doc_id in (0, 1), taken from the largest down
    until the rest of the target is used up; the document at the edge gives its first words only. So
    each source's taken words are its target's whole part. quality: doc_id, weight (over 0; 1 where
    missing). Prefix sums run over the sums of key cells, at most `cells` rows a source, and row by
    row only inside the cell that holds the edge; no source is ever sorted in one task. Rows with equal
    doc_id have equal keys and go by size; rows equal in both are alike. Empty documents take 0 words. A long text is a number
    once it is counted. No row is lost: columns but doc_id, source and text are dropped before the join, so their names
    can't clash.
    """
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    if quality is not None:
        q = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
        d = d.join(q, "doc_id", "left")
    else:
        d = d.withColumn("weight", F.lit(1.0))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    d = d.withColumn("key", F.round(F.pow(u, 1.0 / F.coalesce("weight", F.lit(1.0))), 12))
    d = d.withColumn("cell", F.least(F.floor((1.0 - F.col("key")) * cells), F.lit(cells - 1)).cast("int")).drop("weight")
    cell_sums = d.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cell_sums.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, repeats)
    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = cell_sums.withColumn("before", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)))
    t = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = t.withColumn("rest", F.floor(F.col("target") + 1e-6).cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")
    plan = plan.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("edge", (F.col("before") < F.col("rest")) & (F.col("before") + F.col("cell_size") > F.col("rest")))
    plan = plan.withColumnsRenamed({"source": "s", "cell": "c"})
    d = d.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).drop("s", "c", "cell_size")
    inside = Window.partitionBy("source", "cell").orderBy(F.col("key").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where("edge").withColumn("used", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("used"))))
    plain = d.where("not edge").withColumn("used", F.col("before")).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    both = plain.unionByName(edge)
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "source")


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for documents labelled good, 0.5 for those labelled bad."""
    return labels.where("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))
