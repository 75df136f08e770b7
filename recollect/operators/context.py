"""Prompt assembly under a token budget, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.memory import MEMORY

ICONS = {"working": "🧠", "episodic": "📝", "semantic": "📚", "procedural": "⚙️"}
EXPORT_ICONS = {"working": "⚡", "episodic": "📅", "semantic": "🧠", "procedural": "🔧"}


def _icon(icons: dict, other: str) -> Column:
    out = F.lit(other)
    for k, v in icons.items():
        out = F.when(F.col("type") == k, v).otherwise(out)
    return out


def _fold(items: Column, budget: Column, choose) -> Column:
    """Greedy choice in order: an item that doesn't fit is skipped and later smaller ones may still fit."""
    kind = "array<struct<id:string,text:string,tokens:bigint>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(s, x):
        text, tokens, fits = choose(s["used"], x)
        fits = fits & (s["used"] < budget)
        kept = F.concat(s["kept"], F.array(F.struct(x["id"].alias("id"), text.alias("text"), tokens.alias("tokens"))))
        return F.struct(F.when(fits, kept).otherwise(s["kept"]).alias("kept"), F.when(fits, s["used"] + tokens).otherwise(s["used"]).alias("used"))

    return F.aggregate(items, start, step, lambda s: s["kept"])


def inject(hits: DataFrame, budget: int = 1000, most: int = 5) -> DataFrame:
    """query_id, position, id, text, tokens: of each query's hits (query_id, id, content, importance, final_score) the
    best `most`, summarised, as far as they fit the budget. At most `most` items of a query are folded."""
    score = F.round(F.col("final_score") + F.col("importance"), 6)
    w = Window.partitionBy("query_id").orderBy(score.desc(), "id")
    best = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    best = best.withColumn("summary", T.budget_summary(F.col("content"), F.lit(budget // most)))
    best = best.withColumn("tokens", T.quarter_tokens(F.col("summary")))
    grouped = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "summary", "tokens"))).alias("items"))
    limit = F.lit(budget).cast("long")
    kept = _fold(F.col("items"), limit, lambda used, x: (x["summary"], x["tokens"], used + x["tokens"] <= limit))
    return _positions(grouped.select("query_id", kept.alias("kept")))


def compress(hits: DataFrame, budget: int = 1200, most: int = 10) -> DataFrame:
    """query_id, position, id, text, tokens: whole contents that fit, else their summary of 200 characters, else nothing."""
    score = F.round(F.col("final_score") + F.col("importance"), 6)
    w = Window.partitionBy("query_id").orderBy(score.desc(), "id")
    best = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    best = best.select("query_id", "n", "id", "content", T.mixed_tokens(F.col("content")).alias("tokens"), T.summary(F.col("content")).alias("short"))
    best = best.withColumn("short_tokens", T.mixed_tokens(F.col("short")))
    grouped = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "id", "content", "tokens", "short", "short_tokens"))).alias("items"))
    limit = F.lit(budget).cast("long")

    def choose(used, x):
        whole = used + x["tokens"] <= limit
        return F.when(whole, x["content"]).otherwise(x["short"]), F.when(whole, x["tokens"]).otherwise(x["short_tokens"]), whole | (used + x["short_tokens"] <= limit)

    return _positions(grouped.select("query_id", _fold(F.col("items"), limit + 1, choose).alias("kept")))


def _positions(kept: DataFrame) -> DataFrame:
    key = kept.columns[0]
    x = kept.select(key, F.posexplode("kept").alias("position", "x"))
    return x.select(key, (F.col("position") + 1).alias("position"), "x.id", "x.text", "x.tokens")


def prompt(injected: DataFrame, memories: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, prompt: the text that goes before a conversation; a fixed line for queries without memories."""
    x = injected.join(memories.select("id", "type", "importance"), "id")
    stars = F.repeat(F.lit("★"), F.ceil(F.round(F.col("importance") * 5, 9)).cast("int"))
    section = F.concat(
        F.lit("## "), F.col("position").cast("string"), F.lit(". "), _icon(ICONS, "💭"), F.lit(" "), F.upper("type"), F.lit(" 기억\n**중요도**: "),
        stars, F.format_string(" (%.2f)\n**내용**: ", "importance"), F.col("text"), F.lit("\n\n"),
    )
    parts = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", section.alias("s")))).alias("p"))
    body = F.array_join(F.transform("p", lambda s: s["s"]), "")
    end = "---\n*이 기억들은 현재 대화와 관련된 맥락 정보입니다. 참고하여 더 정확하고 관련성 높은 답변을 제공하세요.*"
    head = F.concat(F.lit("# 관련 기억 ("), F.size("p").cast("string"), F.lit('개)\n\n**검색 쿼리**: "'), F.col("query"), F.lit('"\n\n'))
    return queries.join(parts, "query_id", "left").select("query_id", F.when(F.col("p").isNull(), "관련 기억을 찾을 수 없습니다.").otherwise(F.concat(head, body, F.lit(end))).alias("prompt"))


#: The lines around a client's context by its kind.
HEADERS = {"conversation": "💬 관련 대화 기록:", "task": "📋 관련 작업 기록:", "general": "🧠 관련 기억:"}
NOTHING = {"conversation": "💬 관련 대화 기록이 없습니다.", "task": "📋 관련 작업 기록이 없습니다.", "general": "🧠 관련 기억이 없습니다."}


def client_context(kept: DataFrame, memories: DataFrame, queries: DataFrame, kind: str = "general") -> DataFrame:
    """query_id, content, memories_used, token_count: a system message of the kept memories (query_id, position, id, text, and
    score where there is one), or what is said where there are none."""
    score = F.col("score") if "score" in kept.columns else F.lit(None).cast("double")
    x = kept.withColumn("_score", score).select("query_id", "position", "id", "text", "_score").join(memories.select("id", "type", "importance", "tags", "created_at"), "id")
    filled = F.round(F.col("importance") * 5).cast("int")
    tags = F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    shown = F.when(F.coalesce(F.col("_score"), F.lit(0.0)) != 0, F.concat(F.lit(" (관련도: "), F.format_string("%.1f", F.round(F.col("_score") * 100, 1)), F.lit("%)"))).otherwise("")
    entry = F.concat(
        F.col("position").cast("string"), F.lit(". "), _icon(EXPORT_ICONS, "📝"), F.lit(" "), F.col("text"), tags, shown,
        F.lit("\n   "), F.repeat(F.lit("★"), filled), F.repeat(F.lit("☆"), 5 - filled), F.lit(" "), _iso("created_at"),
    )
    parts = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("s")))).alias("p"))
    body = F.array_join(F.transform("p", lambda s: s["s"]), "\n\n")
    n = F.coalesce(F.size("p"), F.lit(0))
    end = F.concat(F.lit("\n💡 위의 "), n.cast("string"), F.lit('개 기억을 참고하여 "'), F.col("query"), F.lit('"에 대해 답변해주세요.'))
    whole = F.concat_ws("\n\n", F.lit(HEADERS[kind]), body, end)
    none = F.concat(F.lit(NOTHING[kind] + '\n\n💡 "'), F.col("query"), F.lit('"에 대해 새로운 정보로 답변해주세요.'))
    out = queries.join(parts, "query_id", "left").select("query_id", F.when(F.col("p").isNull(), none).otherwise(whole).alias("content"), F.when(F.col("p").isNull(), 0).otherwise(n).alias("memories_used"))
    return out.withColumn("token_count", T.mixed_tokens(F.col("content")))


def within_budget(buffers: DataFrame) -> DataFrame:
    """session_id, position, id, text, tokens: the turns of each working-memory buffer that fit its token budget, in order."""
    items = F.transform("items", lambda x: F.struct(x["turn"].cast("string").alias("id"), F.coalesce(x["text"], F.lit("")).alias("text"), T.quarter_tokens(F.coalesce(x["text"], F.lit(""))).alias("tokens")))
    limit = F.col("token_budget").cast("long")
    return _positions(buffers.select("session_id", _fold(items, limit, lambda used, x: (x["text"], x["tokens"], used + x["tokens"] <= limit)).alias("kept")))


def _iso(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def csv_lines(m: DataFrame) -> DataFrame:
    """id, line: content quoted, tags joined by semicolons. The header is id,content,type,importance,created_at,last_accessed,pinned,tags,privacy_scope,source."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("content"), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = ["id", quoted, "type", F.format_string("%.1f", "importance"), _iso("created_at"), F.coalesce(_iso("last_accessed"), F.lit("")), F.col("pinned").cast("string"), F.array_join("tags", ";"), "privacy_scope", F.coalesce("source", F.lit(""))]
    return m.select("id", F.concat_ws(",", *fields).alias("line"))


def markdown(m: DataFrame) -> DataFrame:
    """id, section: one Markdown section for each memory."""
    stars = F.round(F.col("importance") * 5).cast("int")
    line = lambda name, value: F.concat(F.lit(f"**{name}**: "), value, F.lit("\n"))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " ")
    return m.select(
        "id",
        F.concat(
            F.lit("## "), _icon(EXPORT_ICONS, "📝"), F.lit(" "), F.col("id"), F.lit("\n\n"),
            F.concat(F.lit("**내용**: "), F.col("content"), F.lit("\n\n")),
            line("타입", F.col("type")),
            line("중요도", F.concat(F.repeat(F.lit("★"), stars), F.repeat(F.lit("☆"), 5 - stars), F.format_string(" (%.1f)", "importance"))),
            line("생성일", _iso("created_at")),
            F.when(F.col("last_accessed").isNotNull(), line("마지막 접근", _iso("last_accessed"))).otherwise(""),
            F.when(F.size("tags") > 0, line("태그", tags)).otherwise(""),
            line("공개 범위", F.col("privacy_scope")),
            F.when(F.col("pinned"), F.lit("**고정됨**: ✅\n")).otherwise(""),
            F.lit("\n---\n\n"),
        ).alias("section"),
    )


def json_lines(m: DataFrame) -> DataFrame:
    return m.select("id", F.to_json(F.struct(*m.columns)).alias("json"))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Memories from their JSON (json); a line that is none gives a row of nulls, which a create call refuses."""
    return lines.select(F.from_json("json", MEMORY).alias("m")).select("m.*")


def exported(m: DataFrame, kind: str) -> DataFrame:
    """id and the memory as csv, json or markdown."""
    return {"csv": csv_lines, "json": json_lines, "markdown": markdown}[kind](m)
