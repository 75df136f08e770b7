"""Errors, metrics and alerts: batch forms. Event time throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import query_complexity
from .stats import n_rows, zero_filled


def errors_by_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(n_rows().alias("n"))


def error_counts(log: DataFrame, key: str) -> DataFrame:
    values = C.SEVERITIES if key == "severity" else C.CATEGORIES
    return zero_filled(log.groupBy(key).agg(n_rows().alias("n")), key, values)


def resolution_time(log: DataFrame) -> DataFrame:
    ms = (F.unix_micros("resolved_at") - F.unix_micros("ts")) / 1000
    return log.agg(n_rows().alias("total"), F.count_if("resolved").alias("resolved"), F.round(F.avg(F.when(F.col("resolved"), ms)), 4).alias("avg_resolution_ms"))


def search_errors(log: DataFrame, severity=None, category=None, time_from=None, time_to=None, include_resolved=True, limit: int = 100) -> DataFrame:
    for test in [
        None if severity is None else F.col("severity") == severity,
        None if category is None else F.col("category") == category,
        None if time_from is None else F.col("ts") >= F.lit(time_from),
        None if time_to is None else F.col("ts") <= F.lit(time_to),
        None if include_resolved else ~F.col("resolved"),
    ]:
        log = log if test is None else log.where(test)
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def error_alerts(log: DataFrame, seconds: int = 3600, limits: dict = C.ERROR_LIMITS) -> DataFrame:
    """Errors at which the severity's count over the last hour, this one included, reaches its limit.

    The range frame needs a severity's errors in order; days part them into pieces of a bounded time, each with
    the hour before it carried along, so no severity's whole history is sorted in one task.
    """
    e = log.select("id", "severity", "ts").withColumn("us", F.unix_micros("ts"))
    day = 86_400_000_000
    first = F.floor(F.col("us") / day)
    e = e.withColumn("own", first).withColumn("day", F.explode(F.array_distinct(F.array(first, F.floor((F.col("us") + seconds * 1_000_000) / day)))))
    w = Window.partitionBy("severity", "day").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    limit = F.coalesce(*[F.when(F.col("severity") == s, n) for s, n in limits.items()])
    return e.withColumn("n", F.count(F.lit(1)).over(w)).where((F.col("own") == F.col("day")) & (F.col("n") >= limit)).select("id", "severity", "n")


def thresholds(spark) -> DataFrame:
    return spark.createDataFrame([(m, lv, t, o, c) for m, lv, t, o, _, c in C.THRESHOLDS], "metric string, level string, threshold double, op string, cooldown int")


def triggered(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """id, ts, metric, level, value, threshold, cooldown of values beyond a threshold. limits is a fixed table of a dozen rows."""
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    hit = F.when(op == "gt", v > t).when(op == "lt", v < t).when(op == "gte", v >= t).when(op == "lte", v <= t).otherwise(v == t)
    return metrics.join(limits, "metric").where(hit).select("id", "ts", "metric", "level", "value", "threshold", "cooldown")


def cooled(alerts: DataFrame) -> DataFrame:
    """alerts without those that come before the cooldown of the last kept one of the same metric and level is over.

    An alert that no other of its key comes before within the cooldown is kept in any case, so a key's alerts fall into
    runs, numbered without putting a key in order whole: days count the runs' beginnings and are summed up. What is
    kept inside a run depends on what was kept before, so a run alone is gone through in order, with a state of one time.
    """
    import pandas as pd

    def run(frames):
        last = None
        for pdf in frames:
            keep = []
            for key, at, wait in zip(zip(pdf.metric, pdf.level, pdf.run, strict=True), pdf.us, pdf.cooldown, strict=True):
                keep.append(last is None or last[0] != key or at - last[1] >= wait * 1_000_000)
                if keep[-1]:
                    last = (key, at)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)].drop(columns=["us", "run"])

    schema = ", ".join(f"{c} {t}" for c, t in alerts.dtypes)
    a = _days(alerts.withColumn("us", F.unix_micros("ts")), ("metric", "level"))
    own = Window.partitionBy("metric", "level", "day").orderBy("us", "id")
    before = F.coalesce(F.lag("us").over(own), F.col("last_us"))
    a = a.withColumn("start", F.coalesce(F.col("us") - before >= F.col("cooldown").cast("long") * 1_000_000, F.lit(True)).cast("long"))
    counts = a.groupBy("metric", "level", "day").agg(F.sum("start").alias("starts"))
    earlier = F.coalesce(F.sum("starts").over(Window.partitionBy("metric", "level").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = a.join(counts.select("metric", "level", "day", earlier.alias("earlier")), ["metric", "level", "day"])
    a = a.withColumn("run", F.col("earlier") + F.sum("start").over(own))
    ordered = a.select(*alerts.columns, "us", "run").repartition("metric", "level", "run").sortWithinPartitions("metric", "level", "run", "us", "id")
    return ordered.mapInPandas(run, schema)


def _days(rows: DataFrame, keys) -> DataFrame:
    """rows (us) with day and last_us: the last time of the key before that day. A key has one row of its days in a window."""
    d = rows.withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    last = d.groupBy(*keys, "day").agg(F.max("us").alias("last"))
    before = last.select(*keys, "day", F.lag("last").over(Window.partitionBy(*keys).orderBy("day")).alias("last_us"))
    return d.join(before, [*keys, "day"])


def until_resolved(events: DataFrame) -> DataFrame:
    """id, metric, ts of alerts over events (id, ts, metric, resolve): the first value over its threshold after each resolve
    of the metric. While an alert is active no other is raised; of one time resolves come first.

    An event's segment is the number of resolves up to it: those of earlier days from a row a day, those of its own day from
    a window over that day. The first event of a segment is a minimum.
    """
    e = events.withColumn("day", F.date_trunc("day", "ts"))
    per_day = e.groupBy("metric", "day").agg(F.count_if("resolve").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("metric").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.join(per_day.select("metric", "day", earlier.alias("earlier")), ["metric", "day"])
    own = Window.partitionBy("metric", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("segment", F.col("earlier") + F.count_if("resolve").over(own)).where(~F.col("resolve"))
    first = e.groupBy("metric", "segment").agg(F.min(F.struct("ts", "id")).alias("first"))
    return first.select("first.id", "metric", "first.ts")


def over_threshold(metrics: DataFrame, rules) -> DataFrame:
    """The values (id, ts, metric, value) over their kind's threshold. rules as for first_active."""
    return metrics.where(F.col("value") > _rule(rules, 1))


def _rule(rules, i: int):
    return F.coalesce(*[F.lit(r[i]) if r[0] == "*" else F.when(F.col("metric") == r[0], r[i]) for r in rules])


def cycle(events: DataFrame, errors: DataFrame, step: str = "1 hour") -> DataFrame:
    """start, seconds, requests, hits, lookups, errors of each window in which there was something.

    events: ts, hit, lookup of requests; errors: ts. The windows of both are counted first and then joined, whichever there is.
    """
    w = F.window("ts", step)
    ok = events.groupBy(w).agg(n_rows().alias("requests"), F.count_if("hit").alias("hits"), F.count_if("lookup").alias("lookups"))
    both = ok.join(errors.groupBy(w).agg(n_rows().alias("errors")), "window", "full_outer")
    return both.select(F.col("window.start").alias("start"), (F.unix_seconds("window.end") - F.unix_seconds("window.start")).alias("seconds"), "requests", "hits", "lookups", "errors")


def cycle_metrics(windows: DataFrame) -> DataFrame:
    """ts, metric, value from windows of a cycle: error_rate (% of all), throughput (a second) and cache_performance (% of
    lookups that hit); a value of 0 is not looked at, so it gives no row."""
    n, bad = F.coalesce("requests", F.lit(0)), F.coalesce("errors", F.lit(0))
    rates = F.create_map(
        F.lit("error_rate"), F.when(n + bad > 0, bad / (n + bad) * 100),
        F.lit("throughput"), n / F.col("seconds"),
        F.lit("cache_performance"), F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups") * 100),
    )
    return windows.select(F.col("start").alias("ts"), F.explode(rates).alias("metric", "value")).where("value > 0")


def first_active(metrics: DataFrame, rules=(("*", 80.0, 90.0),)) -> DataFrame:
    """The first value over its kind's threshold of each metric and day, as if each day's alert were resolved at its end.

    rules: kind, threshold, value from which it is critical; the kind * stands for every metric.
    """
    w = Window.partitionBy("metric", "day").orderBy("ts", "id")
    over = over_threshold(metrics, rules).withColumn("day", F.date_trunc("day", "ts"))
    over = over.withColumn("n", F.row_number().over(w)).where("n = 1")
    return over.select("metric", "day", "id", "value", F.when(F.col("value") > _rule(rules, 2), "critical").otherwise("warning").alias("severity"))


def _since(rows: DataFrame, as_of, hours) -> DataFrame:
    return rows if hours is None else rows.where(F.unix_micros("ts") >= F.unix_micros(F.lit(as_of)) - F.lit(hours * 3_600_000_000))


def alert_stats(alerts: DataFrame, key: str, as_of, hours: float | None = 24) -> DataFrame:
    """Alerts of the last hours by level or metric, every known one with its number, 0 too."""
    values = C.LEVELS if key == "level" else C.METRICS
    return zero_filled(_since(alerts, as_of, hours).groupBy(key).agg(n_rows().alias("n")), key, values)


def alert_summary(alerts: DataFrame, as_of, hours: float | None = 24) -> DataFrame:
    """total, active, resolved, avg_resolution_ms (0 if none is resolved) of the last hours' alerts (resolved, resolved_at)."""
    ms = (F.unix_micros("resolved_at") - F.unix_micros("ts")) / 1000
    mean = F.coalesce(F.round(F.avg(F.when(F.col("resolved"), ms)), 4), F.lit(0.0))
    return _since(alerts, as_of, hours).agg(n_rows().alias("total"), F.count_if(~F.col("resolved")).alias("active"), F.count_if("resolved").alias("resolved"), mean.alias("avg_resolution_ms"))


def search_alerts(alerts: DataFrame, level=None, metric=None, resolved=None, time_from=None, time_to=None, limit: int | None = None) -> DataFrame:
    """Alerts that pass every test that is set, the newest first."""
    for test in [
        None if level is None else F.col("level") == level,
        None if metric is None else F.col("metric") == metric,
        None if resolved is None else F.col("resolved") == F.lit(resolved),
        None if time_from is None else F.col("ts") >= F.lit(time_from),
        None if time_to is None else F.col("ts") <= F.lit(time_to),
    ]:
        alerts = alerts if test is None else alerts.where(test)
    out = alerts.orderBy(F.desc("ts"), F.desc("id"), "level")
    return out if limit is None else out.limit(limit)


def without_old_alerts(alerts: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """alerts but resolved ones from before the last hours."""
    old = F.unix_micros("ts") < F.unix_micros(F.lit(as_of)) - F.lit(hours * 3_600_000_000)
    return alerts.where(~(F.col("resolved") & old))


def tool_metrics(runs: DataFrame) -> DataFrame:
    """tool, executions, successes, error_rate, mean_ms of tool runs (tool, ok, time_ms)."""
    share = F.count_if(~F.col("ok")) / n_rows()
    return runs.groupBy("tool").agg(n_rows().alias("executions"), F.count_if("ok").alias("successes"), F.round(share, 6).alias("error_rate"), F.round(F.avg("time_ms"), 5).alias("mean_ms"))


def find_tools(tools: DataFrame, part: str) -> DataFrame:
    """Tools (name, description) that have the part in either, whatever the case."""
    p = F.lit(part.lower())
    return tools.where(F.contains(F.lower("name"), p) | F.contains(F.lower("description"), p))


def write_json_by_day(rows: DataFrame, path: str, at: str = "ts") -> None:
    """Appends rows as JSON lines in a folder for each day."""
    rows.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(path)


def trend(metrics: DataFrame, last: int = 10) -> DataFrame:
    w = Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("id"))
    r = metrics.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    ends = r.groupBy("metric").agg(F.max_by("value", "n").alias("first"), F.min_by("value", "n").alias("last"), n_rows().alias("points"))
    change = (F.col("last") - F.col("first")) / F.col("first")
    flat = (F.col("points") < 2) | (F.col("first") == 0)
    return ends.select("metric", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.when(flat, "stable").when(change > 0.1, "increasing").when(change < -0.1, "decreasing").otherwise("stable").alias("trend"))


def performance_summary(metrics: DataFrame, alerts: DataFrame) -> DataFrame:
    """metric, current (its last value), trend over the last ten, and how many of its alerts are active and there are."""
    last = metrics.groupBy("metric").agg(F.round(F.max_by("value", F.struct("ts", "id")), 6).alias("current"))
    raised = alerts.groupBy("metric").agg(F.count_if(~F.col("resolved")).alias("active"), n_rows().alias("total"))
    out = last.join(trend(metrics).select("metric", "trend"), "metric").join(raised, "metric", "left")
    return out.select("metric", "current", "trend", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("total", F.lit(0)).alias("total"))


def query_stats(log: DataFrame, ms: float = 50) -> DataFrame:
    """runs, queries, avg_ms over all runs, and slow: how many queries take longer than ms on average."""
    q = log.groupBy("query").agg(n_rows().alias("n"), F.sum("time_ms").alias("sum"))
    return q.agg(F.sum("n").alias("runs"), n_rows().alias("queries"), F.round(F.sum("sum") / F.sum("n"), 5).alias("avg_ms"), F.count_if(F.col("sum") / F.col("n") > ms).alias("slow"))


def slow_queries(log: DataFrame, ms: float = 50, limit: int = 10) -> DataFrame:
    q = log.groupBy("query").agg(n_rows().alias("runs"), F.round(F.avg("time_ms"), 5).alias("avg_ms"))
    return q.where(F.col("avg_ms") > ms).orderBy(F.desc("avg_ms"), "query").limit(limit)


#: What ends a WHERE clause.
CLAUSE = r"(?i)WHERE\s+(.+?)(?:\s+ORDER|\s+GROUP|\s+LIMIT|$)"


def query_columns(sql: Column) -> tuple[Column, Column, Column]:
    """The table that an SQL text reads first, the columns that its conditions are on (in order, each once) and those that it is ordered by."""
    table = F.regexp_extract(sql, r"(?i)FROM\s+(\w+)", 1)
    where = F.regexp_extract(sql, CLAUSE, 1)
    conditions = F.transform(F.split(where, "AND|OR"), lambda c: F.regexp_extract(c, r"(\w+)\s*[=<>!]", 1))
    order = F.regexp_extract(sql, r"(?i)ORDER BY\s+(.+?)(?:\s+LIMIT|$)", 1)
    ordered = F.transform(F.split(order, ","), lambda c: F.split(F.trim(c), " ")[0])
    some = lambda a: F.array_distinct(F.filter(a, lambda c: c != ""))
    return table, some(conditions), some(ordered)


def index_advice(log: DataFrame, often: int = 10, very_often: int = 50, slow_ms: float = 1000) -> DataFrame:
    """table, columns, kind, n, time_ms, priority: which indexes a log of queries (query, time_ms) asks for.

    single: a column that more than `often` runs have a condition on. combined: the columns of a query (conditions, then
    order) whose runs take more than slow_ms together. pair: two columns that are in the conditions of more than `often` runs
    together, for which one index serves where two would be read. Runs are counted by query first, columns and
    pairs come from the different queries.
    """
    table, conditions, ordered = query_columns(F.col("query"))
    q = log.groupBy("query").agg(n_rows().alias("n"), F.sum("time_ms").alias("time_ms"))
    q = q.select(table.alias("table"), conditions.alias("conditions"), F.array_distinct(F.concat(conditions, ordered)).alias("all"), "n", "time_ms").where("table <> ''")
    pairs = F.flatten(F.transform("conditions", lambda a: F.transform(F.filter("conditions", lambda b: a < b), lambda b: F.array(a, b))))
    of = lambda columns, kind: q.select("table", F.explode(columns).alias("columns"), F.lit(kind).alias("kind"), "n", "time_ms")
    found = of(F.transform("conditions", lambda c: F.array(c)), "single").unionByName(of(pairs, "pair"))
    found = found.unionByName(q.where((F.size("all") > 1) & (F.col("time_ms") > slow_ms)).select("table", F.col("all").alias("columns"), F.lit("combined").alias("kind"), "n", "time_ms"))
    sums = found.groupBy("table", F.array_join("columns", ",").alias("columns"), "kind").agg(F.sum("n").alias("n"), F.round(F.sum("time_ms"), 4).alias("time_ms"))
    high = (F.col("kind") == "combined") | (F.col("n") > very_often)
    return sums.where((F.col("kind") == "combined") | (F.col("n") > often)).withColumn("priority", F.when(high, "high").otherwise("medium"))


def filter_columns(sql_log: DataFrame) -> DataFrame:
    """column_name, n, priority: how often SQL texts (query, n) filter by a column, and what an index on it would be worth."""
    found = F.regexp_extract_all("query", F.lit(r"(?:WHERE|AND|OR)\s+([a-zA-Z_.]+)\s*(?:=|<|>|IN|LIKE)"), F.lit(1))
    c = sql_log.select(F.explode(F.array_distinct(found)).alias("column_name"), "n").groupBy("column_name").agg(F.sum("n").alias("n"))
    return c.select("column_name", "n", F.when(F.col("n") > 50, "high").when(F.col("n") > 10, "medium").otherwise("low").alias("priority"))


def complexity(sql_log: DataFrame) -> DataFrame:
    return sql_log.select("query", query_complexity(F.col("query")).alias("complexity"))


def newest(rows: DataFrame, n: int, key=None) -> DataFrame:
    """The newest n rows, of each key if there is one."""
    if key is None:
        return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def latest_state(events: DataFrame, key: str = "id") -> DataFrame:
    """The last event of each key (ts, then seq): resolve and acknowledge are events like others."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
