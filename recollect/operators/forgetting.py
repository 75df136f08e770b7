"""Forgetting scores, cleanup and spaced repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scoring as S


def features(memories: DataFrame, as_of) -> DataFrame:
    """memories with recency, usage, duplication_ratio and forget_score. The ratio is the share of other rows of the same type."""
    counts = memories.groupBy("type").agg(F.count(F.lit(1)).alias("same_type"))  # one row a type
    total = memories.agg(F.count(F.lit(1)).alias("total"))
    m = memories.join(counts, "type").crossJoin(F.broadcast(total))
    m = m.withColumns(
        {
            "recency": S.recency(F.col("created_at"), F.col("type"), as_of),
            "usage": S.forget_usage(F.col("last_accessed"), F.col("view_count"), F.col("cite_count"), F.col("edit_count"), as_of),
            "duplication_ratio": (F.col("same_type") - 1) / F.col("total"),
        }
    ).drop("same_type", "total")
    score = S.forget_score(F.col("recency"), F.col("usage"), F.col("duplication_ratio"), F.col("importance"), F.col("pinned"))
    return m.withColumn("forget_score", F.round(score, 6))


def reason(f: DataFrame) -> DataFrame:
    c = F.col
    return f.withColumn("reason", S.forget_reason(c("recency"), c("usage"), c("duplication_ratio"), c("importance"), c("pinned"), c("forget_score")))


def schedule(rows: DataFrame, as_of, threshold: float = 0.7) -> DataFrame:
    """rows: id, current_interval, last_review, importance, usage, helpful_feedback, bad_feedback. The probability uses the new interval."""
    c = F.col
    out = rows.withColumn("next_interval", S.next_interval(c("current_interval"), c("importance"), c("usage"), c("helpful_feedback"), c("bad_feedback")))
    out = out.withColumn("recall_probability", F.round(S.recall_probability(S.age_days(c("last_review"), as_of), c("next_interval")), 6))
    return out.withColumns(
        {
            "next_review": F.timestamp_micros(F.unix_micros("last_review") + c("next_interval") * 86_400_000_000),
            "needs_review": c("recall_probability") <= threshold,
            "priority": F.round(S.review_priority(c("recall_probability"), c("next_interval").cast("double")), 6),
        }
    )


def review_rows(memories: DataFrame, interval: int = 7, helpful: float = 0.5, bad: float = 0.1) -> DataFrame:
    use = F.least(F.lit(1.0), S.raw_usage(F.col("view_count"), F.col("cite_count"), F.col("edit_count")) / 10)
    return memories.select(
        "id", F.lit(interval).alias("current_interval"), F.coalesce("last_accessed", "created_at").alias("last_review"), "importance", use.alias("usage"), F.lit(helpful).alias("helpful_feedback"), F.lit(bad).alias("bad_feedback")
    )


def cleanup(memories: DataFrame, as_of, soft: float = 0.6, hard: float = 0.8) -> DataFrame:
    """Of the unpinned memories: id, forget_score, soft, hard, review. All three may hold for one memory."""
    free = memories.where("not pinned")
    f = features(free, as_of)
    age = S.age_days(F.col("created_at"), as_of)
    due = schedule(review_rows(free), as_of).select("id", F.col("needs_review").alias("review"))
    marks = f.select(
        "id", "type", "forget_score",
        ((F.col("forget_score") >= soft) & (age >= S.by_type(F.col("type"), C.TTL_SOFT_DAYS, 1e9))).alias("soft"),
        ((F.col("forget_score") >= hard) & (age >= S.by_type(F.col("type"), C.TTL_HARD_DAYS, 1e9))).alias("hard"),
    )
    return marks.join(due, "id")


def apply_cleanup(memories: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """The next version of the memories: hard ones gone, soft and reviewed ones touched."""
    left = memories.join(actions.where("hard").select("id"), "id", "left_anti")
    touched = actions.where("soft or review").select("id", F.lit(True).alias("touched"))
    return left.join(touched, "id", "left").withColumn("last_accessed", F.when(F.col("touched"), F.lit(as_of)).otherwise(F.col("last_accessed"))).drop("touched")


def policy_stats(memories: DataFrame, as_of, threshold: float = 0.6) -> DataFrame:
    f = features(memories.where("not pinned"), as_of)
    return f.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("forget_score") >= threshold).alias("candidates"), F.round(F.avg("forget_score"), 5).alias("average"))


def review_performance(schedules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """By 7-day bucket of interval: schedules, due ones, mean probability, and the share recalled (outcomes: id, recalled)."""
    j = schedules.join(outcomes, "id")
    bucket = (F.floor(F.col("next_interval") / 7) * 7).cast("long")
    return j.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("needs_review").alias("due"), F.round(F.avg("recall_probability"), 5).alias("average"), F.round(F.avg(F.col("recalled").cast("double")), 5).alias("success")
    )


def optimal_interval(history: DataFrame) -> DataFrame:
    """history: id, seq, recalled, current_interval. The last five outcomes lengthen, shorten or keep the interval."""
    last = history.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).where("n <= 5")
    rate = last.groupBy("id").agg(F.avg(F.col("recalled").cast("double")).alias("rate"), F.max("current_interval").alias("current_interval"))
    factor = F.when(F.col("rate") > 0.8, 1.2).when(F.col("rate") < 0.6, 0.8).otherwise(1.0)
    return rate.select("id", F.round("rate", 6).alias("rate"), F.ceil(F.round(F.col("current_interval") * factor, 9)).cast("long").alias("interval"))


def preset_intervals(memories: DataFrame, reviews: int = 5) -> DataFrame:
    """id, n, interval: one day, six days, then grown by importance and usage."""
    use = F.least(F.lit(1.0), S.raw_usage(F.col("view_count"), F.col("cite_count"), F.col("edit_count")) / 10)
    grow = 1 + 0.5 * F.col("importance") + 0.3 * use
    steps = F.aggregate(F.sequence(F.lit(3), F.lit(reviews)), F.array(F.lit(1.0), F.lit(6.0)), lambda a, _: F.concat(a, F.array(F.ceil(F.round(F.element_at(a, -1) * grow, 9)).cast("double"))))
    return memories.select("id", F.posexplode(steps).alias("n", "interval")).select("id", (F.col("n") + 1).alias("n"), F.col("interval").cast("long").alias("interval"))
