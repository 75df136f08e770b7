"""Statistics, lists and checks over the memory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scoring as S


def n_rows():
    return F.count(F.lit(1))


def pin_stats(m: DataFrame) -> DataFrame:
    return m.agg(n_rows().alias("total"), F.count_if("pinned").alias("pinned"), F.count_if(~F.col("pinned")).alias("unpinned"), F.round(F.avg("importance"), 5).alias("avg_importance"))


def delete_stats(m: DataFrame) -> DataFrame:
    return m.agg(n_rows().alias("total"), F.count_if("pinned").alias("pinned"), F.count_if(~F.col("pinned")).alias("deletable"), F.round(F.avg("importance"), 5).alias("avg_importance"))


def type_stats(m: DataFrame, as_of, days: int = 30) -> DataFrame:
    old = S.age_days(F.col("created_at"), as_of) > days
    return m.groupBy("type").agg(n_rows().alias("total"), F.count_if("pinned").alias("pinned"), F.count_if(old).alias("old"), F.round(F.avg("importance"), 5).alias("avg_importance"))


def wide_counts(m: DataFrame) -> DataFrame:
    return m.agg(n_rows().alias("total"), F.count_if("pinned").alias("pinned"), *[F.count_if(F.col("type") == t).alias(t) for t in C.TYPES])


def zero_filled(counts: DataFrame, key: str, values) -> DataFrame:
    """counts (key, n) with a row for every value."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def scope_stats(m: DataFrame) -> DataFrame:
    return zero_filled(m.groupBy("privacy_scope").agg(n_rows().alias("n")), "privacy_scope", C.SCOPES)


def popular_tags(m: DataFrame, limit: int = 10) -> DataFrame:
    return m.select(F.explode("tags").alias("tag")).groupBy("tag").agg(n_rows().alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def group_by_tags(m: DataFrame) -> DataFrame:
    key = F.when(F.size("tags") > 0, F.array_join("tags", ",")).otherwise("untagged")
    return m.groupBy(key.alias("tags")).agg(n_rows().alias("n"), F.min("id").alias("first_id"))


def grouped(m: DataFrame, key: str, part_size: int = 1000) -> DataFrame:
    """key, part, n, ids: the memories of each value of type or scope in order, so many to a row, joined by commas."""
    w = Window.partitionBy(key).orderBy("id")
    numbered = m.select(F.coalesce(key, F.lit("unknown")).alias(key), "id").withColumn("part", F.floor((F.row_number().over(w) - 1) / part_size))
    return numbered.groupBy(key, "part").agg(n_rows().alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n, column_name, data_type: a row of each column of each table."""
    out = None
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type")) for c, t in df.dtypes])
        one = df.agg(n_rows().alias("n")).select(F.lit(name).alias("table_name"), "n", F.inline(columns))
        out = one if out is None else out.unionByName(one)
    return out


def dim_stats(e: DataFrame) -> DataFrame:
    return e.agg(n_rows().alias("n"), F.round(F.avg("dim"), 5).alias("avg_dim"), F.min("dim").alias("min_dim"), F.max("dim").alias("max_dim"), F.count_distinct("dim").alias("dims"))


def dim_histogram(e: DataFrame) -> DataFrame:
    return e.groupBy("dim").agg(n_rows().alias("n"), F.min("memory_id").alias("first_id"), F.max("memory_id").alias("last_id"))


def model_stats(e: DataFrame) -> DataFrame:
    """A row of each model, the most frequent first."""
    return e.groupBy("model").agg(n_rows().alias("n"), F.round(F.avg("dim"), 5).alias("avg_dim")).orderBy(F.desc("n"), "model")


def dim_ids(e: DataFrame, part_size: int = 1000) -> DataFrame:
    """dim, part, n, ids: the ids of each dimension in order, so many to a row, joined by commas."""
    w = Window.partitionBy("dim").orderBy("memory_id")
    numbered = e.select("dim", "memory_id", F.floor((F.row_number().over(w) - 1) / part_size).alias("part"))
    return numbered.groupBy("dim", "part").agg(n_rows().alias("n"), F.array_join(F.sort_array(F.collect_list("memory_id")), ",").alias("ids"))


def connectivity(m: DataFrame, e: DataFrame) -> DataFrame:
    lone = m.join(e.select(F.col("memory_id").alias("id")), "id", "left_anti").agg(n_rows().alias("without_embedding"))
    return m.agg(n_rows().alias("items")).crossJoin(e.agg(n_rows().alias("embeddings"))).crossJoin(lone)


def invalid_vectors(e: DataFrame, expected: int) -> DataFrame:
    d = F.col("dim")
    return e.where((d == 0) | (d > 1536) | (d != expected)).select("memory_id", "dim", F.when(d == 0, "empty").when(d > 1536, "too_long").otherwise("unexpected").alias("fault"))


def recent_feedback(f: DataFrame, events, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("event").orderBy(F.desc("created_at"), F.desc("event_id"))
    return f.where(F.col("event").isin(*events)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def pinned_list(m: DataFrame, limit: int = 50) -> DataFrame:
    return m.where("pinned").orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(limit)


def lowest(m: DataFrame, pinned: bool, limit: int = 50) -> DataFrame:
    """Candidates to unpin (pinned) or to delete: least important and oldest first."""
    return m.where(F.col("pinned") == F.lit(pinned)).orderBy("importance", "created_at", "id").limit(limit)


def recommended_unpins(m: DataFrame, as_of, limit: int = 20) -> DataFrame:
    old = m.withColumn("age_days", F.round(S.age_days(F.col("created_at"), as_of), 6)).where("pinned and importance < 0.5 and age_days > 30")
    return old.orderBy("importance", F.desc("age_days"), "id").limit(limit)


def violations(m: DataFrame, e: DataFrame, links: DataFrame, feedback: DataFrame) -> DataFrame:
    """rule, n: how many rows break each constraint."""
    c = F.col
    checks = [
        ("type", m.where(~c("type").isin(*C.TYPES) | c("type").isNull())),
        ("content", m.where(c("content").isNull())),
        ("importance", m.where(~c("importance").between(0, 1))),
        ("privacy_scope", m.where(~c("privacy_scope").isin(*C.SCOPES))),
        ("duplicate_id", m.groupBy("id").count().where("count > 1")),
        ("embedding_memory", e.join(m.select(c("id").alias("memory_id")), "memory_id", "left_anti")),
        ("embedding_unique", e.groupBy("memory_id").count().where("count > 1")),
        ("relation_type", links.where(~c("relation_type").isin(*C.RELATIONS))),
        ("link_source", links.join(m.select(c("id").alias("source_id")), "source_id", "left_anti")),
        ("link_target", links.join(m.select(c("id").alias("target_id")), "target_id", "left_anti")),
        ("feedback_event", feedback.where(~c("event").isin(*C.EVENTS))),
        ("feedback_memory", feedback.join(m.select(c("id").alias("memory_id")), "memory_id", "left_anti")),
    ]
    out = None
    for name, rows in checks:
        one = rows.agg(n_rows().alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


#: The fields that a create call validates.
FIELDS = ("content", "type", "importance", "privacy_scope")


def refusals(fields=FIELDS) -> Column:
    """Why a create call would refuse a row, for each of these fields, joined by commas; empty for one that it takes."""
    c = F.col
    tests = {
        "content": c("content").isNull() | (c("content") == ""),
        "type": ~c("type").isin(*C.TYPES),
        "importance": ~c("importance").between(0, 1),
        "privacy_scope": ~c("privacy_scope").isin(*C.SCOPES),
    }
    return F.concat_ws(",", *[F.when(tests[x], x) for x in fields])


def invalid_memories(m: DataFrame, fields=FIELDS) -> DataFrame:
    """id, errors of rows that a create call would refuse for any of these fields."""
    return m.select("id", refusals(fields).alias("errors")).where("errors <> ''")


def order_statistics(rows: DataFrame, value: str, shares, by=(), bins: int = 1024) -> DataFrame:
    """by..., share, value: of each group the value that has floor(n * share) others before it in order; nulls do not count.

    Equal values are counted first. Then each rank is searched for by counts: the values' range is cut into bins, of which
    the one that holds the rank is cut again, and only its values are put in order. No group is sorted whole.
    """
    keys = list(by) or ["_all"]
    base = rows.where(F.col(value).isNotNull()).withColumn("_all", F.lit(0)).groupBy(*keys, F.col(value).alias("v")).agg(n_rows().alias("n"))
    ends = base.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    wanted = ends.select(*keys, share.alias("share"), "low", "high", "total", F.lit(0).cast("long").alias("before"))
    rank = F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1)
    wanted = wanted.select(*keys, "share", "low", "high", rank.alias("rank"), "before")
    within = Window.partitionBy(*keys, "share").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
    for _ in range(2):
        width = F.col("high") - F.col("low")
        at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / width * bins))).otherwise(0)
        cut = base.join(wanted, keys).where(inside).groupBy(*keys, "share", "rank", "before", at.alias("bin"))
        cut = cut.agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        cut = cut.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within.orderBy("bin")), F.lit(0)))
        held = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))
        wanted = cut.where(held).select(*keys, "share", "low", "high", "rank", "before")
    last = base.join(wanted, keys).where(inside)
    last = last.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(within.orderBy("v")), F.lit(0)))
    return last.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*by, "share", F.col("v").alias("value"))


def latency_stats(log: DataFrame, value: str = "time_ms", by=()) -> DataFrame:
    """n, least, most, mean, and median and 95th percentile by rank, of each group: the values that have floor(n / 2) and
    floor(0.95 * n) others before them in order. Each is one of the values, nothing is interpolated."""
    ranks = order_statistics(log, value, (0.5, 0.95), by)
    pick = lambda p: F.max(F.when(F.col("share") == p, F.col("value")))
    log = log.where(F.col(value).isNotNull())
    own = log.groupBy(*by).agg(n_rows().alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 5).alias("mean"))
    ranks = ranks.groupBy(*by).agg(pick(0.5).alias("median"), F.round(pick(0.95), 5).alias("p95"))
    return own.join(ranks, list(by)) if by else own.crossJoin(ranks)  # one row each


def with_type_defaults(m: DataFrame) -> DataFrame:
    """m (with a type) and default_importance, default_scope and ttl_days of that type."""
    defaults = m.sparkSession.createDataFrame(list(C.TYPE_DEFAULTS), "type string, default_importance double, default_scope string, ttl_days int")
    return m.join(defaults, "type", "left")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n, n_columns of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(n_rows().alias("n")).select(F.lit(name).alias("table_name"), "n", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def missing_tables(spark, required) -> list[str]:
    """Which of the required tables the session's catalog lacks."""
    return [t for t in required if not spark.catalog.tableExists(t)]


def embedding_backup(m: DataFrame, e: DataFrame) -> DataFrame:
    """memory_id, type, content, dim, model, embedding: what a rebuild of the embeddings replaces."""
    return e.join(m.select(F.col("id").alias("memory_id"), "type", "content"), "memory_id").select("memory_id", "type", "content", "dim", "model", "embedding")


def rebuilt(m: DataFrame, sparse: DataFrame) -> DataFrame:
    """memories, embedded, empty: how many memories a new set of embeddings (id, bucket, weight) covers."""
    has = sparse.select("id").distinct().withColumn("has", F.lit(True))
    return m.select("id").join(has, "id", "left").agg(n_rows().alias("memories"), F.count("has").alias("embedded"), F.count_if(F.col("has").isNull()).alias("empty"))
