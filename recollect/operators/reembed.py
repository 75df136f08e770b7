"""Embeddings made anew as a next version: backed up, written aside, verified, then swapped in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.memory import EMBEDDING
from ..storage import Versions, delete, writing


class EmbeddingTable:
    """The embeddings in a folder, one sub-folder a version; a manifest names the current one and the one it replaced."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, f"{path}/manifest")
        self.state: dict = self.versions.current() or {}

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.schema(EMBEDDING).parquet(f"{self.path}/data/{name}")

    def current(self) -> DataFrame:
        return self._folder(self.state["current"]) if self.state else self.spark.createDataFrame([], EMBEDDING)

    def backup(self) -> DataFrame | None:
        """What the current version replaced; None where there was nothing."""
        return self._folder(self.state["before"]) if self.state.get("before") else None

    def replace(self, embeddings: DataFrame, memories: DataFrame, dimensions: int, most_failed: float = 0.0) -> DataFrame:
        """Writes embeddings as the next version, verifies it against the memories and makes it current.

        dim, n, failed of each dimension, and a row without dim for memories that have none. failed: rows whose vector is
        null, not of the wanted dimensions or not finite, whose memory is unknown or has more than one. With a larger share of failed
        rows than most_failed the old version stays, the new files go and an error names the numbers.
        """
        name = uuid.uuid4().hex
        with writing(self.spark):
            embeddings.select(*[F.col(c.split()[0]) for c in EMBEDDING.split(", ")]).write.parquet(f"{self.path}/data/{name}")
        report = verified(self._folder(name), memories, dimensions)
        rows = report.collect()  # a row of each dimension
        n, failed = sum(r["n"] for r in rows if r["dim"] is not None), sum(r["failed"] for r in rows)
        if failed > most_failed * max(n, 1):
            delete(self.spark, f"{self.path}/data/{name}")
            raise ValueError(f"{failed} of {n} new embeddings failed: {[tuple(r) for r in rows if r['failed']]}")
        old = self.state.get("before")
        state = {"current": name, "before": self.state.get("current")}
        self.versions.commit(state)
        self.state = state
        if old:
            delete(self.spark, f"{self.path}/data/{old}")
        return self.spark.createDataFrame(rows, report.schema)


def verified(embeddings: DataFrame, memories: DataFrame, dimensions: int) -> DataFrame:
    """dim, n, failed: embeddings by dimension and how many of them are no good; dim null: memories without one."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size("embedding") == dimensions) & (F.col("dim") == F.size("embedding")) & finite
    known = memories.select(F.col("id").alias("memory_id"), F.lit(True).alias("known"))
    both = embeddings.groupBy("memory_id").agg(F.count(F.lit(1)).alias("times"), F.coalesce(F.max("dim"), F.lit(-1)).alias("dim"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
    both = both.join(known, "memory_id", "full_outer")
    failed = F.when(F.col("times").isNull(), 0).when(F.col("known").isNull(), F.col("times")).otherwise(F.greatest(F.col("bad"), F.col("times") - 1))
    return both.groupBy("dim").agg(F.sum(F.coalesce("times", F.lit(1))).alias("n"), F.sum(failed).alias("failed"))
