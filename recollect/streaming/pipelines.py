"""Structured Streaming forms: ingest, hourly errors, alert cooldown and working-memory sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import SearchIndex
from ..operators.search import light_embedding, postings


def ingest(memories: DataFrame, base: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that appends new memories, their postings and their embeddings to folders under base.

    All three are written in one micro-batch, so no memory is without its vector. Each batch writes folders of its own
    number, so one that is repeated after a failure replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        for name, df in (("items", batch), ("postings", postings(batch)), ("embeddings", light_embedding(batch.select("id", "content")))):
            df.write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")

    return memories.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow(changes: DataFrame, index: SearchIndex, checkpoint: str, trigger: dict | None = None):
    """Starts a query that keeps a search index up with a stream of changes (op: upsert or delete, and a memory's columns).

    Of several changes of one memory in a micro-batch its deletion counts. A micro-batch is one version of the index, by its
    number, so one that is repeated after a failure is passed over if it was taken in.
    """

    def write(batch: DataFrame, number: int) -> None:
        gone = batch.where("op = 'delete'").select("id").distinct()
        index.apply(batch.where("op = 'upsert'").drop("op").join(gone, "id", "left_anti").dropDuplicates(["id"]), gone, number)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_errors(errors: DataFrame, late: str = "10 minutes") -> DataFrame:
    """severity, hour, n of a stream of errors (ts, severity); rows later than the watermark are dropped."""
    w = F.window("ts", "1 hour")
    return errors.withWatermark("ts", late).groupBy(w, "severity").agg(F.count(F.lit(1)).alias("n")).select("severity", F.col("window.start").alias("hour"), "n")


def rolling_error_alerts(errors: DataFrame, limits: dict, late: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """Sliding hours in which a severity reaches its limit."""
    w = F.window("ts", "1 hour", step)
    counts = errors.withWatermark("ts", late).groupBy(w, "severity").agg(F.count(F.lit(1)).alias("n"))
    limit = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in limits.items()])
    return counts.where(F.col("n") >= limit).select("severity", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def cooldown(alerts: DataFrame) -> DataFrame:
    """A stream of alerts (id, ts, metric, level, value, cooldown) without those inside the cooldown of the last one kept.

    The state of a metric and level is the time of the last alert kept; alerts of one micro-batch go in order of time.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        keep = []
        for at, wait in zip(rows.ts, rows.cooldown, strict=True):
            us = at.value // 1000
            keep.append(last is None or us - last >= int(wait) * 1_000_000)
            if keep[-1]:
                last = us
        state.update((last,))
        yield rows[keep]

    schema = ", ".join(f"{c} {t}" for c, t in alerts.dtypes)
    return alerts.groupBy("metric", "level").applyInPandasWithState(run, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def working_sessions(turns: DataFrame, hours: int = 48, late: str = "1 hour") -> DataFrame:
    """session_id, start, end, turns, tokens of working-memory sessions (session_id, ts, text); one ends when no turn comes for so many hours."""
    w = F.session_window("ts", f"{hours} hours")
    out = turns.withWatermark("ts", late).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
    return out.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "turns", "tokens")
