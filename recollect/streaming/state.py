"""Exact streaming state: rows wait until the watermark has passed them and are then taken in the order of their times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

SECOND = 1_000_000
#: The state store that typed states and timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark) -> None:
    """Makes new streams of the session keep their state in RocksDB, as those below must."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Rows (us: event time in microseconds, and the columns of waiting) of a key wait in a list; once a second is over by
    the watermark a timer hands on all that lie before its end, ordered by time and id. So the micro-batches that rows come in
    make no difference; rows later than the watermark are dropped before they come here."""

    #: Columns of a waiting row, us and id first.
    waiting = "us bigint, id bigint"

    def init(self, handle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.waiting.split(", ")]
        self.rows = handle.getListState("waiting", self.waiting)
        self.open()

    def open(self) -> None:
        """Makes further states."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds = set()
        for pdf in rows:
            if len(pdf):
                self.rows.appendList([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in pdf[self.names].itertuples(index=False, name=None)])
                seconds |= set((pdf.us // SECOND).tolist())
        for s in seconds:
            self.handle.registerTimer(int(s + 1) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        due = sorted(r for r in rows if r[0] < end)
        if due:
            left = [r for r in rows if r[0] >= end]
            self.rows.put(left) if left else self.rows.clear()
        out = self.take(key, due, end)
        if out is not None and len(out):
            yield out

    def take(self, key, due: list[tuple], end: int) -> pd.DataFrame | None:
        """What becomes of rows in order; all before end have come."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class HourlyCount(InOrder):
    """Rows at which the key's number of rows over the last hour, rows of the same time included, reaches a limit."""

    def __init__(self, limits: dict, seconds: int = 3600):
        self.limits, self.span = limits, seconds * SECOND

    def open(self) -> None:
        self.recent = self.handle.getListState("recent", "us bigint, n bigint")

    def take(self, key, due, end):
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        at = 0
        out = []
        while at < len(due):
            us = due[at][0]
            stop = at
            while stop < len(due) and due[stop][0] == us:
                stop += 1
            recent = [r for r in recent if r[0] >= us - self.span] + [(us, stop - at)]
            n = sum(r[1] for r in recent)
            if n >= self.limits[key[0]]:
                out += [(r[1], key[0], n) for r in due[at:stop]]
            at = stop
        recent = [r for r in recent if r[0] >= end - self.span]
        self.recent.put(recent) if recent else self.recent.clear()
        if recent:
            self.handle.registerTimer((recent[-1][0] + self.span) // 1000 + 1000)  # when the hour is over nothing is kept
        return pd.DataFrame(out, columns=["id", "severity", "n"])


class Cooldown(InOrder):
    """Alerts but those inside the cooldown of the key's last one kept."""

    waiting = "us bigint, id bigint, cooldown int"

    def open(self) -> None:
        self.last = self.handle.getValueState("last", "us bigint, until bigint")

    def take(self, key, due, end):
        last = self.last.get() if self.last.exists() else None
        last, out = (tuple(last) if last else None), []
        for us, id_, wait in due:
            if last is None or us - last[0] >= wait * SECOND:
                last = (us, us + wait * SECOND)
                out.append((id_, *key))
        if last is not None and last[1] < end:
            self.last.clear()  # a cooldown that is over is as none
        elif last is not None and out:
            self.last.update(last)
            self.handle.registerTimer(last[1] // 1000 + 1000)
        return pd.DataFrame(out, columns=["id", "metric", "level"])


class UntilResolved(InOrder):
    """The first value over its threshold after each resolve of the metric: while an alert is active no other is raised."""

    waiting = "us bigint, id bigint, resolve boolean"

    def open(self) -> None:
        self.active = self.handle.getValueState("active", "id bigint")

    def take(self, key, due, end):
        active, out = self.active.exists(), []
        # Of one time resolves come first.
        for _, id_, resolve in sorted(due, key=lambda r: (r[0], not r[2], r[1])):
            if resolve:
                active = False
            elif not active:
                active = True
                out.append((id_, key[0]))
        if active:
            self.active.update((out[-1][0] if out else self.active.get()[0],))
        else:
            self.active.clear()
        return pd.DataFrame(out, columns=["id", "metric"])


class Buffers(StatefulProcessor):
    """Working memory of a session: its turns are kept until hours after the first of them, and leave one snapshot then.

    A turn at or after that time begins a new buffer. A turn that comes late but before the watermark still belongs to its buffer.
    """

    def __init__(self, hours: int = 48):
        self.span = hours * 3600 * SECOND

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "us bigint, turn bigint, role string, text string")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            if len(pdf):
                none = lambda x: None if x is None or x != x else x
                self.turns.appendList([(int(u), int(t), none(r), none(x)) for u, t, r, x in zip(pdf.us, pdf.turn, pdf.role, pdf.text, strict=True)])
        kept = [tuple(r) for r in self.turns.get()] if self.turns.exists() else []
        if kept:
            self.handle.registerTimer((min(r[0] for r in kept) + self.span) // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept = sorted(((tuple(r)) for r in self.turns.get()), key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")) if self.turns.exists() else []
        now, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        while kept and kept[0][0] + self.span <= now:
            end = kept[0][0] + self.span
            mine = sorted([r[1:] for r in kept if r[0] < end], key=lambda r: (r[0], r[1] or "", r[2] or ""))
            out.append((f"mem_wm_{key[0]}", "episodic", "\n".join(f"{r or ''}: {x or ''}" for _, r, x in mine), pd.Timestamp(end, unit="us")))
            kept = [r for r in kept if r[0] >= end]
        if out:
            self.turns.put(kept) if kept else self.turns.clear()
            if kept:
                self.handle.registerTimer((kept[0][0] + self.span) // 1000)
            yield pd.DataFrame(out, columns=["id", "type", "content", "created_at"])

    def close(self) -> None:
        pass


def _state(df: DataFrame, keys, processor: StatefulProcessor, out: str, late: str) -> DataFrame:
    rows = df.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def error_alerts(errors: DataFrame, limits: dict, late: str = "10 minutes") -> DataFrame:
    """The stream form of monitoring.error_alerts: id, severity, n. The state of a severity is its last hour."""
    return _state(errors.select("id", "ts", "severity"), ["severity"], HourlyCount(limits), "id bigint, severity string, n bigint", late)


def cooled(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream form of monitoring.cooled: id, metric, level. The state of a key goes when its cooldown is over."""
    return _state(alerts.select("id", "ts", "metric", "level", "cooldown"), ["metric", "level"], Cooldown(), "id bigint, metric string, level string", late)


def until_resolved(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream form of monitoring.until_resolved over events (id, ts, metric, resolve): id, metric."""
    return _state(events.select("id", "ts", "metric", "resolve"), ["metric"], UntilResolved(), "id bigint, metric string", late)


def snapshots(turns: DataFrame, hours: int = 48, late: str = "10 minutes") -> DataFrame:
    """id, type, content, created_at of what expired working-memory buffers leave, from turns (session_id, ts, turn, role, text)."""
    return _state(turns.select("session_id", "ts", "turn", "role", "text"), ["session_id"], Buffers(hours), "id string, type string, content string, created_at timestamp", late)


def monitoring_cycle(events: DataFrame, errors: DataFrame, late: str = "10 minutes", step: str = "1 hour") -> DataFrame:
    """The stream form of monitoring.cycle: windows of both streams, counted, then joined by an outer join."""
    w = F.window("ts", step)
    ok = events.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"), F.count_if("lookup").alias("lookups"))
    bad = errors.withWatermark("ts", late).groupBy(w).agg(F.count(F.lit(1)).alias("errors"))
    both = ok.join(bad, "window", "full_outer")
    return both.select(F.col("window.start").alias("start"), F.unix_seconds("window.end") - F.unix_seconds("window.start"), "requests", "hits", "lookups", "errors").toDF("start", "seconds", "requests", "hits", "lookups", "errors")
