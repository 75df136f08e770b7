"""Memory tables: schemas, and the tables derived from the driver's Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AS_OF, CATEGORIES, METRICS, SCOPES, SEVERITIES, TYPES

MEMORY = """id string, type string, content string, importance double, privacy_scope string, created_at timestamp,
last_accessed timestamp, pinned boolean, tags array<string>, source string, view_count bigint, cite_count bigint, edit_count bigint"""
EMBEDDING = "memory_id string, embedding array<double>, dim int, model string, created_at timestamp"
FEEDBACK = "memory_id string, event string, score double, created_at timestamp"
LINK = "source_id string, target_id string, relation_type string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def hours_before(as_of, hours):
    return F.timestamp_micros((F.unix_micros(F.lit(as_of)) - hours * F.lit(3_600_000_000)).cast("long"))


def memory_item(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """One memory per document; usage counters come from the events of the user of the same number."""
    d = table(spark, sf_dir, "documents")
    used = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("doc_id"))
        .agg(
            F.max("ts").alias("last_accessed"),
            F.count_if(F.col("event_type") == "view").alias("view_count"),
            F.count_if(F.col("event_type") == "purchase").alias("cite_count"),
            F.count_if(F.col("event_type") == "signup").alias("edit_count"),
        )
    )
    n = F.col("doc_id")
    return d.join(used, "doc_id", "left").select(
        F.concat(F.lit("mem_"), n.cast("string")).alias("id"),
        _pick(TYPES, n % 4).alias("type"),
        F.col("text").alias("content"),
        (((n * 7) % 11) / F.lit(10.0)).alias("importance"),
        _pick(SCOPES, n % 3).alias("privacy_scope"),
        hours_before(as_of, (n * 37) % 9600).alias("created_at"),
        F.col("last_accessed").cast("timestamp").alias("last_accessed"),
        (n % 17 == 0).alias("pinned"),
        F.array("lang", "source").alias("tags"),
        "source",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("view_count", "cite_count", "edit_count")],
    )


def memory_embedding(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("mem_"), F.col("vec_id").cast("string")).alias("memory_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.size("embedding").alias("dim"),
        F.concat(F.lit("model_"), (F.col("label") % 3).cast("string")).alias("model"),
        F.timestamp_micros(F.unix_micros(F.lit(as_of)) - F.col("vec_id") * 60_000_000).alias("created_at"),
    )


def feedback_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = {"view": "used", "purchase": "helpful", "signup": "edited", "error": "not_helpful", "click": "neglected"}
    names = F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])
    return e.select(
        F.concat(F.lit("mem_"), F.col("user_id").cast("string")).alias("memory_id"),
        names[F.col("event_type")].alias("event"),
        F.col("value").alias("score"),
        F.col("ts").cast("timestamp").alias("created_at"),
        "event_id",
    )


def memory_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duplicates: from the first document of a text to each later one; derived_from: from even documents to half their number."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"))
    first = d.groupBy("sha").agg(F.min("doc_id").alias("first"))
    name = lambda c: F.concat(F.lit("mem_"), c.cast("string"))
    twins = d.join(first, "sha").where(F.col("doc_id") > F.col("first"))
    twins = twins.select(name(F.col("first")).alias("source_id"), name(F.col("doc_id")).alias("target_id"), F.lit("duplicates").alias("relation_type"))
    half = d.where((F.col("doc_id") % 2 == 0) & (F.col("doc_id") > 0))
    half = half.select(name(F.col("doc_id")).alias("source_id"), name((F.col("doc_id") / 2).cast("long")).alias("target_id"), F.lit("derived_from").alias("relation_type"))
    return twins.unionByName(half)


def wm_buffer(spark: SparkSession, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """One working-memory buffer per conversation, its turns in order."""
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("items")
    return c.groupBy("conv_id").agg(turns).select(
        F.col("conv_id").alias("session_id"),
        "items",
        F.lit(4000).alias("token_budget"),
        hours_before(as_of, F.col("conv_id")).alias("created_at"),
        hours_before(as_of, F.col("conv_id") - 48).alias("expires_at"),
    )


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    n = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    resolved = n % 5 == 0
    return e.select(
        n.alias("id"),
        ts.alias("ts"),
        _pick(SEVERITIES, n % 4).alias("severity"),
        _pick(CATEGORIES, n % 10).alias("category"),
        resolved.alias("resolved"),
        F.when(resolved, F.timestamp_micros(F.unix_micros(ts) + (n % 60) * 60_000_000)).alias("resolved_at"),
    )


def metric_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), _pick(METRICS, F.col("event_id") % 6).alias("metric"), "value")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("query"), ((F.col("item_id") * 7) % 120).cast("double").alias("time_ms"))


QUERIES = (("q1", "tion ble"), ("q2", "the tion"), ("q3", "tion ing ble"), ("q4", ""), ("q5", "the of and"), ("q6", "api"), ("q7", "thre thon"), ("q8", "que tion"))


def queries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "query_id string, query string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the fixed queries and the first three words of every benchmark item."""
    more = query_log(spark, sf_dir).select(F.concat(F.lit("q"), (F.col("item_id") + 9).cast("string")).alias("query_id"), "query")
    return queries_table(spark).unionByName(more)


def sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, time_ms: an SQL text for every event, of five kinds."""
    n, text = F.col("event_id"), lambda x: x.cast("string")
    kinds = [
        F.concat(F.lit("SELECT id FROM memory_item WHERE type = '"), F.col("event_type"), F.lit("' AND pinned = "), text(n % 2)),
        F.concat(F.lit("SELECT id FROM memory_item WHERE importance > 0."), text(F.col("user_id") % 10), F.lit(" ORDER BY created_at")),
        F.lit("SELECT COUNT(*) FROM memory_embedding e JOIN memory_item m ON m.id = e.memory_id WHERE dim = 512 GROUP BY type"),
        F.concat(F.lit("SELECT id FROM feedback_event WHERE memory_id = 'mem_"), text(F.col("user_id")), F.lit("' AND event = '"), F.col("event_type"), F.lit("' ORDER BY created_at DESC LIMIT 5")),
        F.concat(F.lit("SELECT id FROM memory_link UNION SELECT id FROM memory_tag WHERE source_id > "), text(n % 7)),
    ]
    return table(spark, sf_dir, "events").select(F.element_at(F.array(*kinds), (n % 5 + 1).cast("int")).alias("query"), F.col("value").alias("time_ms"))


#: The first parts of tool names.
TOOLS = ("remember_note", "recall_all", "search_local", "find_similar", "cleanup_old", "forget_item", "performance_stats", "monitor_cpu", "pin")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, description: a tool for each kind, user and type of event."""
    name = F.concat_ws("_", _pick(TOOLS, F.col("event_id") % len(TOOLS)), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(name.alias("name"), F.concat(F.lit("Runs for "), F.col("event_type")).alias("description")).distinct()


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, hit, lookup of all events but errors: views hit, clicks look up in vain."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").where(kind != "error").select(F.col("ts").cast("timestamp").alias("ts"), (kind == "view").alias("hit"), kind.isin("view", "click").alias("lookup"))


def migrated(df: DataFrame) -> DataFrame:
    """An older table with the columns it lacks, counters 0 where null."""
    spark = df.sparkSession
    return spark.createDataFrame([], MEMORY).unionByName(df, allowMissingColumns=True).fillna(0, ["view_count", "cite_count", "edit_count"])
