"""A facade over the memory tables with the calls that an agent makes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PRESETS, Filters
from .operators import context, dml, forgetting, search


@dataclass(frozen=True)
class MemoryEngine:
    """Immutable: every change gives a new engine over the next version of the tables, so that a plan is never changed underneath."""

    spark: SparkSession
    memories: DataFrame
    embeddings: DataFrame | None = None
    as_of: datetime | None = None

    def now(self) -> datetime:
        return self.as_of or datetime.now()

    def _ids(self, ids) -> DataFrame:
        if len(ids) > 100:
            raise ValueError("at most 100 ids at a time")
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def remember(self, rows: DataFrame) -> MemoryEngine:
        """New memories; where the engine has embeddings, with theirs."""
        new = dml.remember(self.memories, rows, self.now())
        if self.embeddings is None:
            return replace(self, memories=new)
        e = search.light_vectors(rows.select("id", "content"))
        e = e.select(F.col("id").alias("memory_id"), "embedding", F.size("embedding").alias("dim"), F.lit("light").alias("model"), F.lit(self.now()).alias("created_at"))
        return replace(self, memories=new, embeddings=self.embeddings.unionByName(e))

    def recall(self, queries: DataFrame, filters: Filters = Filters(), limit: int = 10, vectors: DataFrame | None = None) -> DataFrame:
        """Hybrid search if there are embeddings and query vectors, else text search."""
        if filters.errors():
            raise ValueError("; ".join(filters.errors()))
        if not 1 <= limit <= 50:
            raise ValueError("limit is from 1 to 50")
        if self.embeddings is not None and vectors is not None:
            return search.hybrid_search(self.memories, self.embeddings, queries, vectors, self.now(), filters, limit)
        return search.text_search(self.memories, queries, self.now(), filters, limit)

    def pin(self, *ids: str) -> tuple[MemoryEngine, DataFrame]:
        status = dml.pin_status(self.memories, self._ids(ids))
        return replace(self, memories=dml.set_pinned(self.memories, status, self.now())), status

    def unpin(self, *ids: str, confirm: bool = False) -> tuple[MemoryEngine, DataFrame]:
        status = dml.unpin_status(self.memories, self._ids(ids), confirm)
        return replace(self, memories=dml.set_pinned(self.memories, status, self.now())), status

    def forget(self, *ids: str, hard: bool = False, confirm: bool = False) -> tuple[MemoryEngine, DataFrame]:
        status = dml.forget_status(self.memories, self._ids(ids), hard, confirm)
        if not hard:
            return replace(self, memories=dml.set_pinned(self.memories, status.where("status <> 'pinned'"), self.now())), status
        gone = status.where("status = 'hard_deleted'").select("id")
        tables = {"memories": (self.memories, ("id",))}
        if self.embeddings is not None:
            tables["embeddings"] = (self.embeddings, ("memory_id",))
        return replace(self, **dml.cascade(tables, gone)), status

    def inject(self, queries: DataFrame, budget: int = 1000, most: int = 5, filters: Filters = Filters(importance_min=0.5), vectors: DataFrame | None = None) -> DataFrame:
        """query_id, prompt of the memories that fit the token budget: by hybrid search, vectors before words, where there are
        embeddings and query vectors (made from the queries' words if none are given), else by words alone."""
        if self.embeddings is None:
            hits = search.text_search(self.memories, queries, self.now(), filters, 2 * most).withColumnRenamed("score", "final_score")
        else:
            if vectors is None:
                made = search.light_vectors(queries.select(F.col("query_id").alias("id"), F.col("query").alias("content")))
                vectors = made.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
            hits = search.hybrid_search(self.memories, self.embeddings, queries, vectors, self.now(), filters, 2 * most, vector_weight=0.7, text_weight=0.3)
            hits = hits.join(self.memories.select("id", "content", "importance"), "id")
        return context.prompt(context.inject(hits, budget, most), self.memories, queries)

    def inject_preset(self, queries: DataFrame, preset: str, most: int = 10) -> DataFrame:
        """query_id, content, memories_used, token_count of a client's context: conversation, task, learning or project."""
        p = PRESETS[preset]
        since = self.now() - timedelta(days=p.recent_days) if p.recent_days else None
        filters = Filters(types=p.types, time_from=since, importance_min=p.importance_min)
        hits = search.text_search(self.memories, queries, self.now(), filters, most).withColumnRenamed("score", "final_score")
        kept = context.compress(hits, p.budget, most).join(hits.select("query_id", "id", F.col("final_score").alias("score")), ["query_id", "id"])
        return context.client_context(kept, self.memories, queries, p.kind)

    def export(self, kind: str, filters: Filters = Filters()) -> DataFrame:
        return context.exported(search.apply_filters(self.memories, filters), kind)

    def written_out(self, path: str) -> MemoryEngine:
        """The same tables read back from Parquet under a path, so that a long row of changes does not pile up in one plan."""
        out = {}
        for name in ("memories", "embeddings"):
            df = getattr(self, name)
            if df is not None:
                df.write.mode("errorifexists").parquet(f"{path}/{name}")
                out[name] = self.spark.read.schema(df.schema).parquet(f"{path}/{name}")
        return replace(self, **out)

    def cleanup(self, dry_run: bool = True, soft: float = 0.6, hard: float = 0.8) -> tuple[MemoryEngine, DataFrame]:
        if dry_run:
            return self, forgetting.policy_stats(self.memories, self.now())
        actions = forgetting.cleanup(self.memories, self.now(), soft, hard)
        return replace(self, memories=forgetting.apply_cleanup(self.memories, actions, self.now())), actions
