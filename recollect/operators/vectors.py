"""Exact vector search by blocks, and an index of cells that is probed and re-ranked exactly."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Versions, delete, writing

#: Bytes of the numbers of one block of vectors.
BLOCK_BYTES = 4 << 20
#: Similarities that are held at a time: a task's memory does not grow with the blocks.
TILE = 1 << 20
BLOCKS = "cell int, size int, ids array<string>, data binary"
HITS = "query_id string, memory_id string, similarity double"
#: Vectors that the cells of an index are fitted on, and cells at most (their centres go to every task).
FITTED, MOST_CELLS = 100_000, 4096


def _packed(most_rows: int):
    """Blocks of rows (cell, id, vector) that follow each other and agree in cell and size. Null vectors drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            size = np.array(pc.fill_null(pc.list_value_length(batch.column("vector")), 0), np.int64)
            rows = np.flatnonzero(size > 0)
            rows = rows[np.lexsort((size[rows], cell[rows]))]
            out: list[list] = [[], [], [], []]
            at = 0
            while at < len(rows):
                c, n = cell[rows[at]], size[rows[at]]
                stop = at + int(np.searchsorted((cell[rows[at:]] != c) | (size[rows[at:]] != n), True))
                own = rows[at : min(stop, at + max(1, min(most_rows, BLOCK_BYTES // (8 * int(n)))))]
                flat = pc.take(batch.column("vector"), pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                for column, x in zip(out, (c, n, pc.take(batch.column("id"), pa.array(own)), flat.tobytes()), strict=True):
                    column.append(x)
                at += len(own)
            ids = pa.array([x.to_pylist() for x in out[2]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), ids, pa.array(out[3], pa.binary())], ["cell", "size", "ids", "data"])

    return run


def blocks(rows: DataFrame, id_: str, vector: str, cell=None, most_rows: int = 1 << 20) -> DataFrame:
    """cell, size, ids, data: the vectors as matrices. Rows should come in order of their cells."""
    c = F.lit(0) if cell is None else F.col(cell)
    return rows.select(c.cast("int").alias("cell"), F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(_packed(most_rows), BLOCKS)


def similarities(q: np.ndarray, e: np.ndarray, score: str) -> np.ndarray:
    """Of every row of q with every row of e: cosine (0 where a norm is 0), or 1 - distance but no less than 0."""
    dot, nq, ne = q @ e.T, (q * q).sum(1)[:, None], (e * e).sum(1)[None, :]
    if score == "cosine":
        norm = np.sqrt(nq) * np.sqrt(ne)
        s = np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)
    else:
        s = np.maximum(0.0, 1 - np.sqrt(np.maximum(0.0, nq + ne - 2 * dot)))
    return np.round(s, 6)


def _nearest(limit: int, threshold: float, score: str):
    """From rows (q_block, q_ids, q_data, ids, data, size): of each pair of blocks the vectors that may be among a query's
    limit best. What is below the limit-th of a block that the task has seen is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                n = batch.column("size")[i].as_py()
                q, e = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, n) for c in ("q_data", "data"))
                ids, names = batch.column("ids")[i].values, batch.column("q_ids")[i].values
                least = seen.setdefault(batch.column("q_block")[i].as_py(), np.full(len(q), -np.inf))
                step, order = max(1, TILE // len(e)), None
                for low in range(0, len(q), step):
                    s, own = np.fmax(similarities(q[low : low + step], e, score), -np.inf), least[low : low + step]
                    if len(e) >= limit:
                        np.maximum(own, np.partition(s, len(e) - limit, axis=1)[:, len(e) - limit], out=own)
                    bound = np.maximum(own, threshold)[:, None]
                    top = s >= bound
                    many = np.flatnonzero(np.count_nonzero(top, axis=1) > limit)
                    if len(many):  # ties at the limit-th: the smallest ids of a block, as in the final order
                        order = pc.array_sort_indices(ids, null_placement="at_start").to_numpy() if order is None else order
                        t, at = s[many][:, order], bound[many]
                        tie = t == at
                        left = limit - np.count_nonzero(t > at, axis=1)
                        kept = np.zeros_like(tie)
                        kept[:, order] = (t > at) | tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= left[:, None])
                        top[many] = kept
                    a, b = np.nonzero(top)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(low + a)), ids.take(pa.array(b)), pa.array(s[a, b])], ["query_id", "memory_id", "similarity"])

    return run


def best(hits: DataFrame, limit: int) -> DataFrame:
    """The limit most similar memories of each query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "memory_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def vector_search(embeddings: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = 0.7, score: str = "cosine", most_queries: int = 4096) -> DataFrame:
    """query_id, memory_id, similarity, rank: each query vector (query_id, vector) against all embeddings of its size.

    Both sides are packed into blocks, and every block of queries meets every block of embeddings as a matrix product
    in tasks of its own: a stated query set against all rows, in blocks. Nothing goes through the driver, and what moves on
    is limit rows a query and pair of blocks. most_queries: vectors of a block of queries.
    """
    # Queries are dealt before they are packed, so their blocks are few; finished blocks are dealt again, so each pair reads
    # them from there and packs nothing anew.
    e = blocks(embeddings, "memory_id", "embedding").select("size", "ids", "data").repartition(F.xxhash64(F.col("ids")[0]))
    q = blocks(queries.repartition("query_id"), "query_id", "vector", most_rows=most_queries)
    q = q.select(F.monotonically_increasing_id().alias("q_block"), F.col("size").alias("q_size"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    q = q.repartition("q_block")
    # Written as no equality, so that blocks are not dealt by the size, which is one value as a rule.
    pairs = e.crossJoin(q).where(F.abs(F.col("size") - F.col("q_size")) < 1)
    return best(pairs.drop("q_size").mapInArrow(_nearest(limit, threshold, score), HITS), limit)


class VectorIndex:
    """Unit vectors in cells around k-means centres, as blocks in a folder.

    A rebuild fits the centres on a bounded sample of FITTED vectors and writes every vector, whole, into the folder of its
    nearest centre; the manifest names the build and has each cell's centre, number and least cosine to the centre. A
    search goes to the cells nearest to each query; search_exactly then goes on to all cells that may hold a better one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, f"{path}/manifest")
        self.state: dict = self.versions.current() or {}

    def available(self, source: str | None = None) -> bool:
        """Whether there are vectors to search, and if a source is named, whether they are of that."""
        return self.status()["available"] and source in (None, self.state.get("source"))

    def rebuild(self, embeddings: DataFrame, cells: int | None = None, seed: int = 7, source: str | None = None) -> None:
        """Writes all embeddings (memory_id, embedding) of the most frequent size; rows without a vector or of norm 0 are left out."""
        e = embeddings.select("memory_id", F.col("embedding").cast("array<double>").alias("embedding"))
        e = e.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0 and not isnan(norm)")
        sizes = e.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
        if not sizes:
            self._commit({"count": 0, "dimensions": 0, "cells": [], "source": source})
            return
        size, n = sizes[0]["size"], sizes[0]["n"]
        unit = e.where(F.size("embedding") == size).select("memory_id", F.transform("embedding", lambda x: x / F.col("norm")).alias("embedding"))
        k = cells or int(max(1, min(MOST_CELLS, round(n**0.5 / 2))))
        part = max(1, -(-n // FITTED))
        sample = unit.where(F.pmod(F.xxhash64("memory_id"), F.lit(part)) == 0).select(array_to_vector("embedding").alias("features"))
        model = KMeans(k=k, seed=seed, maxIter=10, initSteps=2).fit(sample)
        centres = np.array(model.clusterCenters())
        shared = self.spark.sparkContext.broadcast(centres)

        def placed(batches):
            for batch in batches:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                far = ((shared.value**2).sum(1)[None, :] - 2 * (x @ shared.value.T)) if len(batch) else np.zeros((0, 1))
                cell = far.argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["memory_id", "embedding", "cell"])

        name = uuid.uuid4().hex
        base = f"{self.path}/builds/{name}"
        with writing(self.spark):
            rows = unit.mapInArrow(placed, "memory_id string, embedding array<double>, cell int")
            rows = rows.hint("rebalance", "cell").sortWithinPartitions("cell")
            blocks(rows, "memory_id", "embedding", "cell").write.partitionBy("cell").parquet(base)
        shared.unpersist()
        self._commit({"build": name, "count": n, "dimensions": size, "cells": self._summary(base, centres), "source": source})

    def _summary(self, base: str, centres: np.ndarray) -> list[dict]:
        """Each cell's centre, number of vectors and least cosine to the direction of the centre."""
        unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

        def least(batches):
            for batch in batches:
                rows = []
                for i in range(len(batch)):
                    c = batch.column("cell")[i].as_py()
                    x = np.frombuffer(batch.column("data")[i].as_py()).reshape(len(batch.column("ids")[i]), -1)
                    rows.append((c, len(x), float((x @ unit[c]).min())))
                c, n, low = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(n, pa.int64()), pa.array(low, pa.float64())], ["cell", "n", "low"])

        found = self.spark.read.schema(BLOCKS).parquet(base).mapInArrow(least, "cell int, n bigint, low double").groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        return [{"cell": r["cell"], "n": r["n"], "low": r["low"], "centre": unit[r["cell"]].tolist()} for r in found.orderBy("cell").collect()]

    def _commit(self, state: dict) -> None:
        old = self.state.get("build")
        self.versions.commit(state)
        self.state = state
        if old:
            delete(self.spark, f"{self.path}/builds/{old}")

    def status(self) -> dict:
        """available, table_exists, record_count, dimensions, as the manifest and the folder have them."""
        there = bool(self.state.get("build")) and self.state["build"] in self.versions.names(f"{self.path}/builds")
        return {"available": there and self.state["count"] > 0, "table_exists": there, "record_count": self.state.get("count", 0), "dimensions": self.state.get("dimensions", 0)}

    def _centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells = self.state["cells"]
        return np.array([c["cell"] for c in cells], np.int32), np.array([c["centre"] for c in cells]), np.array([c["low"] for c in cells])

    def _asked(self, queries: DataFrame, choose, extra=()) -> DataFrame:
        """Blocks of (query_id, vector) for each cell that choose takes for a query."""
        number, centre, low = self._centres()
        size = self.state["dimensions"]

        def run(batches):
            for batch in batches:
                x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                q, c = choose(np.clip(x @ centre.T, -1, 1), low, batch)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(q)), batch.column("vector").take(pa.array(q)), pa.array(number[c])], ["query_id", "vector", "cell"])

        right = queries.where(F.size("vector") == size).select("query_id", F.col("vector").cast("array<double>").alias("vector"), *extra)
        rows = right.mapInArrow(run, "query_id string, vector array<double>, cell int")
        return blocks(rows.repartition("cell").sortWithinPartitions("cell"), "query_id", "vector", "cell", 4096)

    def _hits(self, asked: DataFrame, limit: int, threshold: float) -> DataFrame:
        e = self.spark.read.schema(BLOCKS).parquet(f"{self.path}/builds/{self.state['build']}").select("cell", "size", "ids", "data")
        q = asked.select("cell", F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
        pairs = e.join(q, "cell")
        return pairs.select("size", "ids", "data", "q_block", "q_ids", "q_data").mapInArrow(_nearest(limit, threshold, "cosine"), HITS)

    def search(self, queries: DataFrame, limit: int = 10, threshold: float = 0.7, probes: int = 8) -> DataFrame:
        """query_id, memory_id, similarity, rank from the probes cells nearest to each query; similarities are exact."""
        if not self.status()["available"]:
            return self.spark.createDataFrame([], HITS + ", rank int")

        def choose(s, low, batch):
            k = min(probes, s.shape[1])
            c = np.argpartition(-s, k - 1, axis=1)[:, :k] if len(s) else np.zeros((0, k), np.int64)
            return np.repeat(np.arange(len(s)), k), c.ravel()

        return best(self._hits(self._asked(queries, choose), limit, threshold), limit)

    def search_exactly(self, queries: DataFrame, limit: int = 10, threshold: float = 0.7, probes: int = 8) -> DataFrame:
        """As search, and then from every cell that may hold something better: a vector's angle to the query is no less than
        the angle of query and centre less the cell's widest angle."""
        if not self.status()["available"]:
            return self.spark.createDataFrame([], HITS + ", rank int")
        first = self.search(queries, limit, threshold, probes)
        worst = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("worst"))
        bound = queries.join(worst, "query_id", "left").withColumn("least", F.when(F.col("n") >= limit, F.greatest("worst", F.lit(threshold))).otherwise(F.lit(threshold)))

        def choose(s, low, batch):
            angle = np.arccos(s) - np.arccos(np.clip(low, -1, 1))[None, :]
            most = np.cos(np.maximum(angle, 0))
            return np.nonzero(most + 2e-6 >= batch.column("least").to_numpy()[:, None])

        return best(self._hits(self._asked(bound, choose, ("least",)), limit, threshold), limit)

    def drop(self) -> None:
        delete(self.spark, self.path)
        self.state = {}
