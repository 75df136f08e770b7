"""Changes to the memory tables: each gives the next version of a table, or rows to append, and a status per command."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.memory import MEMORY
from ..storage import stored
from .stats import refusals


def remember(memories: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """memories with new rows (id, content, and any other column) appended, defaults where they lack a value."""
    empty = new.sparkSession.createDataFrame([], MEMORY)
    rows = empty.unionByName(new, allowMissingColumns=True)
    defaults = {"type": F.lit("episodic"), "importance": F.lit(0.5), "privacy_scope": F.lit("private"), "created_at": F.lit(as_of), "pinned": F.lit(False), "view_count": F.lit(0), "cite_count": F.lit(0), "edit_count": F.lit(0)}
    return memories.unionByName(rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}), allowMissingColumns=True)


def _status(memories: DataFrame, commands: DataFrame, known) -> DataFrame:
    m = memories.select("id", "pinned", "importance", F.lit(True).alias("found"))
    return commands.select("id").distinct().join(m, "id", "left").select("id", F.when(F.col("found").isNull(), "not_found").otherwise(known).alias("status"))


def pin_status(memories: DataFrame, commands: DataFrame) -> DataFrame:
    """id, status of commands (id): pinned, already_pinned or not_found."""
    return _status(memories, commands, F.when(F.col("pinned"), "already_pinned").otherwise("pinned"))


def unpin_status(memories: DataFrame, commands: DataFrame, confirm: bool = False, important: float = 0.8) -> DataFrame:
    """unpinned, already_unpinned, requires_confirmation (important ones, unless confirmed) or not_found."""
    ask = (F.col("importance") > important) & F.lit(not confirm)
    return _status(memories, commands, F.when(~F.col("pinned"), "already_unpinned").when(ask, "requires_confirmation").otherwise("unpinned"))


def forget_status(memories: DataFrame, commands: DataFrame, hard: bool = False, confirm: bool = False) -> DataFrame:
    """soft_deleted, hard_deleted, pinned (refused), requires_confirmation (hard without confirm) or not_found."""
    done = "requires_confirmation" if hard and not confirm else "hard_deleted" if hard else "soft_deleted"
    return _status(memories, commands, F.when(F.col("pinned"), "pinned").otherwise(done))


def batch_result(status: DataFrame, by=()) -> DataFrame:
    """by..., status, ids in order, n: one row per outcome, of each batch where by names its columns. A batch is the 100 ids at
    most that a call takes, so a row's ids are."""
    return status.groupBy(*by, "status").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


def split_batch(rows: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame, Observation]:
    """accepted, refused, observed: new rows (id and the columns of memories) one by one. refused has errors: what is wrong with
    a row's values, repeated (an id that comes again in the batch: the first by content stays) or exists.

    observed has the numbers accepted and refused once one of the two has been written.
    """
    w = Window.partitionBy("id").orderBy("content")
    known = memories.select("id", F.lit(True).alias("_known")).distinct()
    marked = rows.withColumn("_n", F.row_number().over(w)).join(known, "id", "left")
    errors = F.concat_ws(",", F.nullif(refusals(), F.lit("")), F.when(F.col("_n") > 1, "repeated"), F.when(F.col("_known"), "exists"))
    seen = Observation("batch")
    marked = marked.withColumn("errors", errors).drop("_n", "_known")
    marked = marked.observe(seen, F.count_if(F.col("errors") == "").alias("accepted"), F.count_if(F.col("errors") != "").alias("refused"))
    return marked.where("errors = ''").drop("errors"), marked.where("errors <> ''"), seen


def set_pinned(memories: DataFrame, status: DataFrame, as_of) -> DataFrame:
    """The next version after pin_status, unpin_status or a soft forget_status without the pinned ones, which it refuses."""
    s = status.where(F.col("status").isin("pinned", "unpinned", "soft_deleted"))
    changed = memories.join(s, "id", "left")
    return changed.withColumns(
        {
            "pinned": F.when(F.col("status") == "pinned", True).when(F.col("status").isNotNull(), False).otherwise(F.col("pinned")),
            "last_accessed": F.when(F.col("status").isNotNull(), F.lit(as_of)).otherwise(F.col("last_accessed")),
        }
    ).drop("status")


def status_feedback(status: DataFrame, as_of, priority: float = 3.0) -> DataFrame:
    """Feedback rows that the successful commands append; those of forget_status come without the pinned ones, which it refuses."""
    s = F.col("status")
    event = F.when(s == "pinned", "helpful").when(s == "unpinned", "edited").when(s == "soft_deleted", "neglected")
    rows = status.select(F.col("id").alias("memory_id"), event.alias("event"), F.when(s == "pinned", priority).otherwise(0.0).alias("score"), F.lit(as_of).alias("created_at"))
    return rows.where("event is not null")


def cascade(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that point, by any of the named columns, at an id of gone."""
    out = {}
    for name, (df, keys) in tables.items():
        for key in keys:
            df = df.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*df.columns)
        out[name] = df
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key over both tables; of equal times the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def update_memory(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories with the non-null columns of changes (id, ...) in place; unknown ids are appended."""
    c = changes.select(F.col("id"), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != "id"])
    joined = memories.join(c, "id", "full_outer")
    return joined.select("id", *[F.coalesce(f"_{x}", x).alias(x) if x in changes.columns else F.col(x) for x in memories.columns if x != "id"])


def change_tags(memories: DataFrame, add=(), remove=()) -> DataFrame:
    """Tags with add at the end, each once, and without remove; order stays."""
    out = F.coalesce("tags", F.array().cast("array<string>"))
    if add:
        out = F.array_distinct(F.concat(out, F.array(*map(F.lit, add))))
    if remove:
        out = F.filter(out, lambda t: ~t.isin(*remove))
    return memories.withColumn("tags", out)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new).dropDuplicates(["source_id", "target_id", "relation_type"])


def feedback_rows(feedback: DataFrame, as_of) -> DataFrame:
    """feedback: memory_id, helpful, score. Rows for the event log."""
    return feedback.select("memory_id", F.when(F.col("helpful"), "helpful").otherwise("not_helpful").alias("event"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(as_of).alias("created_at"))


def expired_working(memories: DataFrame, as_of, days: int = 2) -> DataFrame:
    """Unpinned working memories older than so many days, which the admin cleanup deletes."""
    edge = F.timestamp_micros(F.unix_micros(F.lit(as_of)) - F.lit(days * 86_400_000_000))
    return memories.where((F.col("type") == "working") & ~F.col("pinned") & (F.col("created_at") < edge))


def tag_tables(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """memory_tag (tag_id, name), numbered by name, and memory_item_tag (memory_id, tag_id).

    Names are numbered range by range: each range counts its own, and the ranges' sums, one row each, shift them.
    """
    pairs = memories.select(F.col("id").alias("memory_id"), F.explode(F.array_distinct("tags")).alias("name"))
    names = stored(pairs.select("name").distinct().repartitionByRange("name").withColumn("part", F.spark_partition_id()), "tag-names")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = names.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    tags = names.withColumn("own", own).join(F.broadcast(shift), "part").select((F.col("own") + F.col("shift")).cast("int").alias("tag_id"), "name")
    return tags, pairs.join(tags, "name").select("memory_id", "tag_id")


def memory_links(links: DataFrame, part_size: int = 1000) -> DataFrame:
    """id, part, and the memory's link targets by relation, in order, so many of each relation to a row."""
    kinds = ("cause_of", "derived_from", "duplicates", "contradicts")
    w = Window.partitionBy("source_id", "relation_type").orderBy("target_id")
    numbered = links.withColumn("part", F.floor((F.row_number().over(w) - 1) / part_size))
    lists = [F.array_join(F.sort_array(F.collect_list(F.when(F.col("relation_type") == k, F.col("target_id")))), ",").alias(k) for k in kinds]
    return numbered.groupBy(F.col("source_id").alias("id"), "part").agg(*lists)


def expired_buffers(buffers: DataFrame, as_of) -> DataFrame:
    """Working-memory buffers whose time is over."""
    return buffers.where(F.col("expires_at") <= F.lit(as_of))


def buffer_snapshots(buffers: DataFrame, as_of) -> DataFrame:
    """The episodic memory (id, type, content, created_at) that is left of each expired buffer: a line for each turn."""
    line = lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))
    content = F.array_join(F.transform("items", line), "\n")
    return expired_buffers(buffers, as_of).select(F.concat(F.lit("mem_wm_"), F.col("session_id").cast("string")).alias("id"), F.lit("episodic").alias("type"), content.alias("content"), F.lit(as_of).alias("created_at"))
