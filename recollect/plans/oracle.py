"""SQL twins of the registered queries, for DuckDB. Common tables are put before a query by name."""

from __future__ import annotations

import re

from ..config import CATEGORIES, HALF_LIFE_DAYS, LEVELS, METRICS, MONITOR_RULES, SEVERITIES, STOP_WORDS, TECHNICAL_QUERIES, TECHNICAL_WORDS, THRESHOLDS, TTL_HARD_DAYS, TTL_SOFT_DAYS, TYPE_DEFAULTS
from ..functions.text import ACCENTED, PLAIN
from ..sources.memory import QUERIES, TOOLS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(key: str, values: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in values.items()) + f" ELSE {other} END"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
STOP = _list(STOP_WORDS)


def age(ts: str) -> str:
    return f"((epoch_us({AS_OF}) - epoch_us({ts})) / 86400000000.0)"


def recency() -> str:
    return f"exp(-ln(2.0::DOUBLE) * {age('created_at')}::DOUBLE / ({_case('type', HALF_LIFE_DAYS, '30.0')})::DOUBLE)"


def raw_usage() -> str:
    return "(ln(1.0::DOUBLE + view_count) + 2 * ln(1.0::DOUBLE + cite_count) + 0.5::DOUBLE * ln(1.0::DOUBLE + edit_count))"


IMPORTANCE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, importance + CASE WHEN pinned THEN 0.2 ELSE 0.0 END::DOUBLE + (CASE type WHEN 'semantic' THEN 0.1 WHEN 'working' THEN -0.05 WHEN 'procedural' THEN 0.05 ELSE 0.0 END)::DOUBLE))"
WHITE = "[ \\t\\n\\r\\f\\x0B]+"


def words(x: str) -> str:
    return f"regexp_split_to_array(lower({x}), '{WHITE}')"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE)"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({x}, '')), '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def bm25_simple(query: str, content: str) -> str:
    # Words that a list lacks have no position, so the filter's length is the term's frequency.
    return (
        f"CASE WHEN {query} = '' OR {content} = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, coalesce(list_sum(list_transform({words(query)}, lambda t: "
        f"(CASE WHEN list_contains(cw, t) THEN ln(2.0::DOUBLE) * len(list_filter(cw, lambda w: w = t)) * 2.2::DOUBLE / (len(list_filter(cw, lambda w: w = t)) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(cw) / 100.0::DOUBLE)) ELSE 0.0::DOUBLE END))), 0.0) / 10.0::DOUBLE) END"
    )


#: How a title of 20 characters meets a query of several words.
TITLE = "CASE WHEN substr(content, 1, 20) = '' THEN 0.0 WHEN lower(substr(content, 1, 20)) = 'the of tion tion' THEN 1.0 WHEN starts_with(lower(substr(content, 1, 20)), 'the of tion tion') THEN 0.5 WHEN list_has_any(list_transform(range(1, 15), lambda i: substr('the of tion tion', i, 3)), list_transform(range(1, length(substr(content, 1, 20)) - 1), lambda i: substr(lower(substr(content, 1, 20)), i, 3))) THEN 0.2 ELSE 0.0 END"


def tag_match(query: str, tags: str) -> str:
    return f"CASE WHEN len({tags}) = 0 THEN 0.0::DOUBLE ELSE {jaccard(words(query), f'list_transform({tags}, lambda t: lower(t))')} END"


TABLES = {
    "used": """SELECT user_id AS doc_id, max(ts) AS last_accessed, count(*) FILTER (event_type = 'view') AS view_count,
  count(*) FILTER (event_type = 'purchase') AS cite_count, count(*) FILTER (event_type = 'signup') AS edit_count FROM events GROUP BY user_id""",
    "memory_item": f"""SELECT 'mem_' || d.doc_id AS id, d.doc_id AS n, ['working', 'episodic', 'semantic', 'procedural'][d.doc_id % 4 + 1] AS type, text AS content,
  (((d.doc_id * 7) % 11) / 10.0)::DOUBLE AS importance, ['private', 'team', 'public'][d.doc_id % 3 + 1] AS privacy_scope,
  {AS_OF} - to_hours((d.doc_id * 37) % 9600) AS created_at, last_accessed::TIMESTAMP AS last_accessed, d.doc_id % 17 = 0 AS pinned, [lang, source] AS tags, source,
  coalesce(view_count, 0) AS view_count, coalesce(cite_count, 0) AS cite_count, coalesce(edit_count, 0) AS edit_count
  FROM documents d LEFT JOIN used USING (doc_id)""",
    "memory_embedding": f"SELECT 'mem_' || vec_id AS memory_id, vec_id AS n, embedding::DOUBLE[] AS embedding, len(embedding)::INT AS dim, 'model_' || (label % 3) AS model, {AS_OF} - to_minutes(vec_id) AS created_at FROM embeddings",
    "embedded": "SELECT e.* FROM memory_embedding e WHERE EXISTS (SELECT 1 FROM memory_item m WHERE m.id = e.memory_id)",
    "vectors": "SELECT 'q' || (n // 20 + 1) AS query_id, embedding AS vector FROM memory_embedding WHERE n % 20 = 0",
    "feedback_event": "SELECT 'mem_' || user_id AS memory_id, CASE event_type WHEN 'view' THEN 'used' WHEN 'purchase' THEN 'helpful' WHEN 'signup' THEN 'edited' WHEN 'error' THEN 'not_helpful' WHEN 'click' THEN 'neglected' END AS event, value AS score, ts::TIMESTAMP AS created_at, event_id FROM events",
    "memory_link": """SELECT 'mem_' || first AS source_id, 'mem_' || doc_id AS target_id, 'duplicates' AS relation_type FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE doc_id > first
  UNION ALL SELECT 'mem_' || doc_id, 'mem_' || (doc_id // 2), 'derived_from' FROM documents WHERE doc_id % 2 = 0 AND doc_id > 0""",
    "error_log": f"SELECT event_id AS id, ts::TIMESTAMP AS ts, {_list(SEVERITIES)}[event_id % 4 + 1] AS severity, {_list(CATEGORIES)}[event_id % 10 + 1] AS category, event_id % 5 = 0 AS resolved, CASE WHEN event_id % 5 = 0 THEN ts::TIMESTAMP + to_minutes(event_id % 60) END AS resolved_at FROM events WHERE event_type = 'error'",
    "metric_stream": f"SELECT event_id AS id, ts::TIMESTAMP AS ts, {_list(METRICS)}[event_id % 6 + 1] AS metric, value FROM events WHERE event_type <> 'error'",
    "thresholds": f"SELECT * FROM (VALUES {_values(THRESHOLDS)}) t(metric, level, threshold, op, duration, cooldown)",
    "alerts": "SELECT id, ts, metric, level, value, threshold::DOUBLE AS threshold, cooldown FROM metric_stream JOIN thresholds USING (metric) WHERE CASE WHEN op = 'gt' THEN value > threshold ELSE value < threshold END",
    "alert_log": "SELECT *, id % 4 = 0 AS resolved, CASE WHEN id % 4 = 0 THEN ts + to_minutes(id % 30) END AS resolved_at FROM alerts",
    "wm_buffer": f"SELECT conv_id AS session_id, {AS_OF} - to_hours(conv_id - 48) AS expires_at, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS content FROM conversations GROUP BY conv_id",
    "query_log": "SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS query, ((item_id * 7) % 120)::DOUBLE AS time_ms FROM benchmark",
    "asked": "SELECT query_id, query FROM queries UNION ALL SELECT 'q' || (item_id + 9), query FROM query_log",
    "sql_log": """SELECT CASE event_id % 5 WHEN 0 THEN 'SELECT id FROM memory_item WHERE type = ' || q || event_type || q || ' AND pinned = ' || (event_id % 2) WHEN 1 THEN 'SELECT id FROM memory_item WHERE importance > 0.' || (user_id % 10) || ' ORDER BY created_at'
  WHEN 2 THEN 'SELECT COUNT(*) FROM memory_embedding e JOIN memory_item m ON m.id = e.memory_id WHERE dim = 512 GROUP BY type'
  WHEN 3 THEN 'SELECT id FROM feedback_event WHERE memory_id = ' || q || 'mem_' || user_id || q || ' AND event = ' || q || event_type || q || ' ORDER BY created_at DESC LIMIT 5'
  ELSE 'SELECT id FROM memory_link UNION SELECT id FROM memory_tag WHERE source_id > ' || (event_id % 7) END AS query, value AS time_ms FROM (SELECT *, chr(39) AS q FROM events)""",
    "tools": f"SELECT DISTINCT {_list(TOOLS)}[event_id % {len(TOOLS)} + 1] || '_' || user_id AS name, 'Runs for ' || event_type AS description FROM events",
    "cycle": """SELECT coalesce(a.hour, b.hour) AS ts, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(hits, 0) AS hits, coalesce(lookups, 0) AS lookups FROM (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS requests, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type IN ('view', 'click')) AS lookups FROM events WHERE event_type <> 'error' GROUP BY 1) a
  FULL JOIN (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.hour = b.hour""",
    "cycle_metrics": """SELECT ts, metric, value FROM (SELECT ts, 'error_rate' AS metric, errors / (requests + errors)::DOUBLE * 100 AS value FROM cycle UNION ALL SELECT ts, 'throughput', requests / 3600::DOUBLE FROM cycle
  UNION ALL SELECT ts, 'cache_performance', hits / lookups::DOUBLE * 100 FROM cycle WHERE lookups > 0) WHERE value > 0""",
    "advised": """SELECT query, count(*) AS n, sum(time_ms) AS time_ms, regexp_extract(query, 'FROM (\\w+)', 1) AS "table", list_filter(['type', 'pinned', 'importance', 'dim', 'memory_id', 'event', 'source_id'],
  lambda c: list_contains(regexp_extract_all(regexp_extract(query, 'WHERE (.+?)( ORDER| GROUP| LIMIT|$)', 1), '(\\w+) *[=<>!]', 1), c)) AS conditions, list_filter([nullif(regexp_extract(query, 'ORDER BY (\\w+)', 1), '')], lambda c: c IS NOT NULL) AS ordered FROM sql_log GROUP BY query""",
    "queries": f"SELECT * FROM (VALUES {_values(QUERIES)}) t(query_id, query)",
    "cleaned": f"SELECT query_id, query, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(trim(query), '{WHITE}', ' ', 'g'), '[^a-zA-Z0-9가-힣 ]', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({STOP}, lower(w))), ' ') AS cleaned FROM queries",
    "terms": f"SELECT DISTINCT query_id, unnest({tokens('cleaned')}) AS term FROM cleaned",
    "need": "SELECT query_id, count(*) AS need FROM terms GROUP BY query_id",
    "postings": f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({tokens("concat_ws(' ', content, array_to_string(tags, ' '), source)")}) AS term FROM memory_item) GROUP BY id, term",
    "lengths": "SELECT id, sum(tf)::BIGINT AS dl FROM postings GROUP BY id",
    "bm25": """SELECT query_id, id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))) AS bm25 FROM postings JOIN terms USING (term) JOIN lengths USING (id)
  JOIN (SELECT term, greatest(ln((docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 1e-6) AS idf, any_value(mean) AS mean FROM postings, (SELECT count(*) AS docs, avg(dl) AS mean FROM lengths) GROUP BY term, docs) USING (term)
  JOIN need USING (query_id) GROUP BY query_id, id, need HAVING count(*) = need""",
    "features": f"""SELECT *, round(0.35::DOUBLE * (1 - recency) + 0.25::DOUBLE * (1 - usage) + 0.2::DOUBLE * duplication_ratio - 0.15::DOUBLE * importance - 0.3::DOUBLE * pinned::INT, 6) AS forget_score FROM (
  SELECT *, {recency()} AS recency, greatest(coalesce(exp(-{age("last_accessed")}::DOUBLE / 30), 0.0), least(1.0::DOUBLE, {raw_usage()} / 10)) AS usage,
    (count(*) OVER (PARTITION BY type) - 1) / (count(*) OVER ())::DOUBLE AS duplication_ratio FROM memory_item WHERE NOT pinned)""",
    "schedule": f"""SELECT *, round((1 - recall_probability) + ln(next_interval + 1.0::DOUBLE) / 10, 6) AS priority, recall_probability <= 0.7 AS needs_review, last_review + to_days(next_interval::INT) AS next_review FROM (
  SELECT *, round(exp(-{age("last_review")}::DOUBLE / next_interval), 6) AS recall_probability FROM (
    SELECT id, n, coalesce(last_accessed, created_at) AS last_review, ceil(round(7 * (1 + 0.6::DOUBLE * importance + 0.4::DOUBLE * least(1.0::DOUBLE, {raw_usage()} / 10) + 0.5::DOUBLE * 0.5 - 0.7::DOUBLE * 0.1), 9))::BIGINT AS next_interval FROM memory_item))""",
    "actions": f"""SELECT f.id, forget_score, forget_score >= 0.6 AND {age("created_at")} >= {_case("type", TTL_SOFT_DAYS, "1e9")} AS soft,
  forget_score >= 0.62 AND {age("created_at")} >= {_case("type", TTL_HARD_DAYS, "1e9")} AS hard, needs_review AS review FROM features f JOIN schedule USING (id)""",
    "vector_pairs": "SELECT query_id, memory_id, round(list_dot_product(vector, embedding) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(embedding, embedding))), 6) AS similarity FROM embedded, vectors",
    "many_pairs": """SELECT q.memory_id AS query_id, e.memory_id, round(list_dot_product(q.embedding, e.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding))), 6) AS similarity,
  round(greatest(0.0, 1 - list_distance(q.embedding, e.embedding)), 6) AS near FROM (SELECT * FROM memory_embedding WHERE n % 20 = 0) q, embedded e""",
    "embed_words": f"SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9_ \\t\\n\\r\\f\\x0B가-힣]', ' ', 'g'), '{WHITE}'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))) AS word FROM texts",
    "word_stats": f"""SELECT id, word, n, abs(hash) % 512 AS bucket, n * idf AS tfidf, n * ln(CASE WHEN n > 3 THEN 0.8 WHEN regexp_matches(word, '^[0-9_가-힣]') AND length(word) > 2 THEN 1.3 WHEN regexp_matches(word, '{TECHNICAL_WORDS}') THEN 1.5 ELSE 1.0 END::DOUBLE) AS lf
  FROM (SELECT id, word, count(*) AS n FROM embed_words GROUP BY id, word) JOIN word_hash USING (word)""",
    "word_hash": """SELECT word, list_reduce(list_concat([0::BIGINT], list_transform(string_split(word, ''), lambda c: ord(c)::BIGINT)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS hash,
  greatest(0.1::DOUBLE, (1.0 + CASE WHEN length(word) > 5 THEN 0.5 ELSE 0 END + CASE WHEN length(word) > 8 THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(word, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(word, '[^a-zA-Z가-힣]') THEN 0.3 ELSE 0 END)::DOUBLE) AS idf
  FROM (SELECT DISTINCT word FROM embed_words)""",
    "cells": """SELECT id, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM (
  SELECT id, bucket, sum(tfidf) / sum(sum(n)) OVER (PARTITION BY id) * exp(sum(lf)) AS raw FROM word_stats GROUP BY id, bucket)""",
    "weights": f"""SELECT query_id, v / (v + t) AS vector_weight, t / (v + t) AS text_weight FROM (SELECT query_id,
  CASE WHEN technical THEN 0.8 WHEN phrase THEN 0.4 WHEN short THEN 0.7 ELSE 0.6 END::DOUBLE AS v, CASE WHEN technical THEN 0.2 WHEN phrase THEN 0.6000000000000001 WHEN short THEN 0.30000000000000004 ELSE 0.4 END::DOUBLE AS t FROM (
    SELECT query_id, regexp_matches(q, '^({TECHNICAL_QUERIES})$') AS technical, len(string_split(q, ' ')) >= 3 AS phrase, length(q) <= 10 AS short FROM (
      SELECT query_id, lower(trim(regexp_replace(query, '{WHITE}', ' ', 'g'))) AS q FROM queries)))""",
    "gone": "SELECT id FROM memory_item WHERE n % 3 = 0 AND NOT pinned",
    "changed_item": "SELECT * REPLACE (CASE WHEN n % 10 = 0 THEN 'changed tion ' || content ELSE content END AS content) FROM memory_item WHERE n % 10 <> 5",
}


for _name in ("postings", "lengths", "bm25"):
    TABLES[f"changed_{_name}"] = re.sub(r"\b(memory_item|postings|lengths)\b", lambda m: {"memory_item": "changed_item"}.get(m[0], f"changed_{m[0]}"), TABLES[_name])
#: For queries over asked() in place of the fixed ones.
ASKED = {"fixed": TABLES["queries"], "asked": TABLES["asked"].replace("FROM queries", "FROM fixed"), "queries": "SELECT * FROM asked"}


def text_search(where: str, limit: int, usage: str) -> str:
    """Common tables candidates, features and ranked for one set of filters."""
    use = {"constant": "ln(2.0::DOUBLE) / 10", "counters": f"CASE WHEN {raw_usage()} = 0 THEN 0.1 ELSE least(1.0::DOUBLE, {raw_usage()} / 10) END", "batch": f"CASE WHEN min({raw_usage()}) OVER q = max({raw_usage()}) OVER q THEN 0.5 ELSE ({raw_usage()} - min({raw_usage()}) OVER q) / (max({raw_usage()}) OVER q - min({raw_usage()}) OVER q + 1e-6) END"}[usage]
    return f"""kept AS (SELECT * FROM memory_item WHERE {where}),
candidates AS (
  SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, created_at DESC, id) AS rn FROM (
    SELECT query_id, id, bm25, created_at FROM bm25 JOIN kept USING (id)
    UNION ALL SELECT query_id, id, 0.0, created_at FROM queries, kept WHERE query_id NOT IN (SELECT query_id FROM need)))
  WHERE rn <= {3 * limit}),
cand AS (SELECT c.rn, q.query_id, q.query, m.*, {words("content")} AS cw FROM candidates c JOIN kept m USING (id) JOIN queries q USING (query_id)),
dups AS (SELECT a.query_id, a.id, max({jaccard("a.cw", "b.cw")}) AS dup FROM cand a JOIN cand b ON a.query_id = b.query_id AND b.rn < a.rn GROUP BY a.query_id, a.id),
feats AS (SELECT query_id, id, rn, type, importance, content, CASE WHEN query = '' OR content = '' THEN 0.0 ELSE 0.3::DOUBLE * {bm25_simple("query", "content")} + 0.05::DOUBLE * {tag_match("query", "tags")} END AS relevance,
  {recency()} AS recency, {IMPORTANCE} AS importance_score, {use} AS usage, coalesce(dup, 0.0) AS dup
  FROM cand LEFT JOIN dups USING (query_id, id) WINDOW q AS (PARTITION BY query_id)),
scored AS (SELECT *, round(0.5::DOUBLE * relevance + 0.2::DOUBLE * recency + 0.2::DOUBLE * importance_score + 0.1::DOUBLE * usage - 0.15::DOUBLE * dup, 6) AS score FROM feats),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rn) AS rank FROM scored QUALIFY rank <= {limit})"""


RANKED = """SELECT query_id, rank, id, round(relevance, 5) AS relevance, round(recency, 5) AS recency, importance_score, round(usage, 5) AS usage, round(dup, 5) AS dup, score,
  coalesce(nullif(concat_ws(', ', CASE WHEN relevance > 0.7 THEN '높은 관련성' END, CASE WHEN recency > 0.8 THEN '최근 생성' END, CASE WHEN importance_score > 0.8 THEN '높은 중요도' END, CASE WHEN score > 0.9 THEN '종합 점수 우수' END), ''), '일반 검색 결과') AS recall_reason FROM ranked"""
SOME = "type IN ('semantic', 'episodic')"


def sql(body: str, extra: str = "", over: dict | None = None) -> str:
    """body with the common tables that it names, and those that they name, before it. over: other versions of some."""
    tables = TABLES | (over or {})
    found: list[str] = []
    open_: set[str] = set()

    def need(text: str) -> None:
        for name in tables:
            if name not in found and name not in open_ and re.search(rf"(?:FROM|JOIN|,)\s+{name}(?!\w)", text):
                open_.add(name)
                need(tables[name])
                found.append(name)

    need(extra + body)
    parts = [f"{n} AS ({tables[n]})" for n in found] + ([extra] if extra else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def top(table: str, columns: str, order: str, k: int, by: str = "query_id") -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {table} QUALIFY rank <= {k}"


def value(expression: str) -> str:
    return f"SELECT id, round({expression}, 6) AS value FROM memory_item"


CLEAN = {
    "mem_scan_unpinned": "SELECT id, type, importance, created_at, view_count, cite_count, edit_count FROM memory_item WHERE NOT pinned",
    "mem_lookup_ids": "SELECT id, type, content, pinned FROM memory_item WHERE id IN ('mem_3', 'mem_17', 'mem_199', 'mem_x')",
    "filter_type_scope_pinned": "SELECT id, type, privacy_scope FROM memory_item WHERE type IN ('semantic', 'working') AND privacy_scope = 'team' AND NOT pinned",
    "filter_time_range": "SELECT id, created_at FROM memory_item WHERE created_at BETWEEN TIMESTAMP '2023-06-01' AND TIMESTAMP '2023-12-01'",
    "filter_tags_any": "SELECT id, array_to_string(tags, ',') AS tags FROM memory_item WHERE list_has_any(tags, ['fr', 'src3'])",
    "filter_importance_range": "SELECT id, importance FROM memory_item WHERE importance BETWEEN 0.3::DOUBLE AND 0.6::DOUBLE",
    "recent_days": f"SELECT id, created_at FROM memory_item WHERE created_at >= {AS_OF} - INTERVAL 30 DAYS",
    "related_by_tag": "SELECT a.id, b.id AS related_id, len(list_intersect(a.tags, b.tags))::INT AS shared, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id)::INT AS rank FROM memory_item a, memory_item b WHERE a.n % 20 = 0 AND list_has_any(a.tags, b.tags) QUALIFY rank <= 6",
    "like_search": "SELECT id, type FROM memory_item WHERE (content ILIKE '%tion%' OR array_to_string(tags, ',') ILIKE '%tion%' OR source ILIKE '%tion%') AND type = 'semantic'",
    "like_search_leaky": "SELECT id, type FROM memory_item WHERE content ILIKE '%src1%' OR array_to_string(tags, ',') ILIKE '%src1%' OR source ILIKE '%src1%' AND type = 'semantic'",
    "tokens_clean": f"SELECT query_id, cleaned, lower(trim(regexp_replace(query, '{WHITE}', ' ', 'g'))) AS normal FROM cleaned",
    "postings": "SELECT * FROM postings",
    "doc_lengths": "SELECT * FROM lengths",
    "fts_match_and": "SELECT query_id, id FROM postings JOIN terms USING (term) JOIN need USING (query_id) GROUP BY query_id, id, need HAVING count(*) = need UNION ALL SELECT query_id, id FROM queries, memory_item WHERE query_id NOT IN (SELECT query_id FROM need)",
    "fts_bm25_topk": top("(SELECT query_id, id, round(bm25, 6) AS bm25 FROM bm25)", "query_id, id, bm25", "bm25 DESC, id", 30),
    "fts_second_page": "SELECT query_id, id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS rank FROM bm25 QUALIFY rank BETWEEN 11 AND 20",
    "delete_stats": "SELECT count(*) AS total, count(*) FILTER (pinned) AS pinned, count(*) FILTER (NOT pinned) AS deletable, round(avg(importance), 5) AS avg_importance FROM memory_item",
    "forget_distribution": "SELECT type, count(id) AS n FROM (VALUES ('working'), ('episodic'), ('semantic'), ('procedural')) v(type) LEFT JOIN (SELECT * FROM memory_item WHERE NOT pinned) USING (type) GROUP BY type",
    "query_stats": "SELECT sum(n)::BIGINT AS runs, count(*) AS queries, round(sum(s) / sum(n), 5) AS avg_ms, count(*) FILTER (s / n > 50) AS slow FROM (SELECT query, count(*) AS n, sum(time_ms) AS s FROM query_log GROUP BY query)",
    "similar_logged_queries": f"""SELECT * FROM (SELECT a.q AS query, b.q AS other, round(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))::DOUBLE, 6) AS overlap FROM (
      SELECT DISTINCT q, list_distinct(string_split(q, ' ')) AS w FROM (SELECT lower(trim(regexp_replace(query, '{WHITE}', ' ', 'g'))) AS q FROM query_log)) a JOIN (
      SELECT DISTINCT q, list_distinct(string_split(q, ' ')) AS w FROM (SELECT lower(trim(regexp_replace(query, '{WHITE}', ' ', 'g'))) AS q FROM query_log)) b ON a.q < b.q) WHERE overlap >= 0.3""",
    "rank_recency": value(recency()),
    "rank_importance": value(IMPORTANCE),
    "rank_usage": value(f"CASE WHEN {raw_usage()} = 0 THEN 0.1 ELSE least(1.0::DOUBLE, {raw_usage()} / 10) END"),
    "rank_bm25_simple": f"SELECT id, round({bm25_simple("'the of tion tion'", 'content')}, 6) AS value FROM (SELECT *, {words('content')} AS cw FROM memory_item)",
    "rank_tag_jaccard": value(tag_match("'fr src3 other'", "tags")),
    "rank_title_hit": value("CASE WHEN lower(substr(content, 1, 20)) = 'tion' THEN 1.0 WHEN starts_with(lower(substr(content, 1, 20)), 'tion') THEN 0.5 WHEN contains(lower(substr(content, 1, 20)), 'tio') OR contains(lower(substr(content, 1, 20)), 'ion') THEN 0.2 ELSE 0.0 END"),
    "calc_importance": value("greatest(0.0, least(1.0, 0.5 + CASE WHEN length(content) > 500 THEN 0.2 WHEN length(content) > 200 THEN 0.1 WHEN length(content) < 50 THEN -0.1 ELSE 0.0 END + CASE WHEN len(tags) > 5 THEN 0.2 WHEN len(tags) > 2 THEN 0.1 WHEN len(tags) = 0 THEN -0.1 ELSE 0.0 END + CASE type WHEN 'semantic' THEN 0.2 WHEN 'procedural' THEN 0.1 WHEN 'working' THEN -0.1 ELSE 0.0 END))::DOUBLE"),
    "vector_topk": top("vector_pairs", "query_id, memory_id, similarity", "similarity DESC, memory_id", 10).replace("FROM vector_pairs", "FROM vector_pairs WHERE similarity >= 0.15"),
    "vector_topk_by_type": top("(SELECT v.* FROM vector_pairs v JOIN memory_item m ON m.id = v.memory_id WHERE type = 'semantic' AND similarity >= 0.15)", "query_id, memory_id, similarity", "similarity DESC, memory_id", 10),
    "vector_l2_similarity": top("(SELECT query_id, memory_id, round(greatest(0.0, 1 - list_distance(vector, embedding)), 6) AS similarity FROM embedded, vectors)", "query_id, memory_id, similarity", "similarity DESC, memory_id", 5),
    "vector_topk_many": top("(SELECT * FROM many_pairs WHERE similarity >= 0.15)", "query_id, memory_id, similarity", "similarity DESC, memory_id", 10),
    "vector_topk_by_type_many": top("(SELECT v.* FROM many_pairs v JOIN memory_item m ON m.id = v.memory_id WHERE type = 'semantic' AND similarity >= 0.15)", "query_id, memory_id, similarity", "similarity DESC, memory_id", 10),
    "vector_l2_similarity_many": top("(SELECT query_id, memory_id, near AS similarity FROM many_pairs)", "query_id, memory_id, similarity", "similarity DESC, memory_id", 5),
    "vec_text_outer_union": "SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.id, t.id) AS id, vector_score, text_score FROM (SELECT query_id, memory_id AS id, similarity AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS rank FROM vector_pairs WHERE similarity >= 0.15 QUALIFY rank <= 20) v FULL JOIN (SELECT query_id, id, round(bm25, 6) AS text_score FROM bm25) t ON v.query_id = t.query_id AND v.id = t.id",
    "find_similar": """SELECT id, similar_id, similarity, rank FROM (SELECT q.memory_id AS id, e.memory_id AS similar_id, similarity, row_number() OVER (PARTITION BY q.memory_id ORDER BY similarity DESC, e.memory_id) AS rank FROM (
      SELECT q.memory_id AS a, e.memory_id AS b, round(list_dot_product(q.embedding, e.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding))), 6) AS similarity
      FROM embedded q JOIN memory_item qm ON qm.id = q.memory_id, embedded e JOIN memory_item em ON em.id = e.memory_id WHERE q.n % 20 = 0 AND qm.type = em.type) p JOIN embedded q ON q.memory_id = a JOIN embedded e ON e.memory_id = b WHERE similarity >= 0.15) WHERE rank <= 5""",
    "search_within_ids": "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS rn FROM queries, memory_item WHERE id IN ('mem_3', 'mem_17', 'mem_68', 'mem_199', 'mem_x')",
    "embedding_missing": "SELECT id, type FROM memory_item WHERE id NOT IN (SELECT memory_id FROM memory_embedding)",
    "adaptive_weights": "SELECT query_id, round(vector_weight, 6) AS vector_weight, round(text_weight, 6) AS text_weight FROM weights",
    "search_stats": f"SELECT lower(trim(regexp_replace(query, '{WHITE}', ' ', 'g'))) AS query, count(*) AS text_hits, sum(item_id % 3)::BIGINT AS vector_hits, count(*) AS total_searches FROM query_log GROUP BY 1",
    "forget_features": "SELECT id, round(recency, 6) AS recency, round(usage, 6) AS usage, round(duplication_ratio, 6) AS duplication_ratio, forget_score FROM features",
    "forget_candidates": "SELECT id, type, forget_score, concat_ws(', ', CASE WHEN recency < 0.3 THEN '오래된 기억' END, CASE WHEN usage < 0.2 THEN '사용되지 않음' END, CASE WHEN duplication_ratio > 0.7 THEN '중복도 높음' END, CASE WHEN importance < 0.3 THEN '중요도 낮음' END, '고정되지 않음') AS reason FROM features WHERE forget_score >= 0.6",
    "cleanup_actions": "SELECT * FROM actions",
    "soft_candidates": "SELECT id, forget_score FROM actions WHERE soft",
    "hard_candidates": "SELECT id, forget_score FROM actions WHERE hard",
    "cleanup_summary": "SELECT count(*) AS total, count(*) FILTER (soft) AS soft, count(*) FILTER (hard) AS hard, count(*) FILTER (review) AS review FROM actions",
    "cleanup_next_version": f"SELECT m.id, CASE WHEN soft OR review THEN {AS_OF} ELSE last_accessed END AS last_accessed, pinned FROM memory_item m LEFT JOIN actions a USING (id) WHERE coalesce(hard, false) = false",
    "forgetting_stats": "SELECT count(*) AS total, count(*) FILTER (forget_score >= 0.6) AS candidates, round(avg(forget_score), 5) AS average FROM features",
    "review_schedule": "SELECT id, next_interval, next_review, recall_probability, needs_review, priority FROM schedule",
    "review_performance": "SELECT (next_interval // 7) * 7 AS bucket, count(*) AS total, count(*) FILTER (needs_review) AS due, round(avg(recall_probability), 5) AS average, round(avg((n % 3 <> 0)::INT::DOUBLE), 5) AS success FROM schedule GROUP BY 1",
    "optimal_interval": "SELECT id, round(rate, 6) AS rate, ceil(round(10 * CASE WHEN rate > 0.8 THEN 1.2 WHEN rate < 0.6 THEN 0.8 ELSE 1.0 END, 9))::BIGINT AS interval FROM (SELECT memory_id AS id, avg((event IN ('helpful', 'used'))::INT::DOUBLE) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY event_id DESC) AS n FROM feedback_event) WHERE n <= 5 GROUP BY memory_id)",
    "preset_intervals": f"""WITH RECURSIVE steps AS (SELECT id, 2 AS n, 6.0::DOUBLE AS interval, 1 + 0.5::DOUBLE * importance + 0.3::DOUBLE * least(1.0::DOUBLE, {raw_usage()} / 10) AS grow FROM memory_item UNION ALL SELECT id, n + 1, ceil(round(interval * grow, 9)), grow FROM steps WHERE n < 5)
      SELECT id, n::INT AS n, interval::BIGINT AS interval FROM steps UNION ALL SELECT id, 1, 1 FROM memory_item""",
    "pin_stats": "SELECT count(*) AS total, count(*) FILTER (pinned) AS pinned, count(*) FILTER (NOT pinned) AS unpinned, round(avg(importance), 5) AS avg_importance FROM memory_item",
    "type_stats": f"SELECT type, count(*) AS total, count(*) FILTER (pinned) AS pinned, count(*) FILTER ({age('created_at')} > 30) AS old, round(avg(importance), 5) AS avg_importance FROM memory_item GROUP BY type",
    "wide_counts": "SELECT count(*) AS total, count(*) FILTER (pinned) AS pinned, count(*) FILTER (type = 'working') AS working, count(*) FILTER (type = 'episodic') AS episodic, count(*) FILTER (type = 'semantic') AS semantic, count(*) FILTER (type = 'procedural') AS procedural FROM memory_item",
    "scope_stats": "SELECT privacy_scope, count(id) AS n FROM (VALUES ('private'), ('team'), ('public')) v(privacy_scope) LEFT JOIN memory_item USING (privacy_scope) GROUP BY privacy_scope",
    "popular_tags": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memory_item) GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
    "group_by_tags": "SELECT CASE WHEN len(tags) > 0 THEN array_to_string(tags, ',') ELSE 'untagged' END AS tags, count(*) AS n, min(id) AS first_id FROM memory_item GROUP BY 1",
    "pinned_list": "SELECT id, importance, created_at FROM memory_item WHERE pinned ORDER BY importance DESC, created_at DESC, id LIMIT 50",
    "unpin_candidates": "SELECT id, importance, created_at FROM memory_item WHERE pinned ORDER BY importance, created_at, id LIMIT 50",
    "delete_candidates": "SELECT id, importance, created_at FROM memory_item WHERE NOT pinned ORDER BY importance, created_at, id LIMIT 50",
    "recommended_unpins": f"SELECT id, importance, round({age('created_at')}, 6)::DOUBLE AS age_days FROM memory_item WHERE pinned AND importance < 0.5 AND {age('created_at')} > 30 ORDER BY importance, age_days DESC, id LIMIT 20",
    "validate_memories": "SELECT id, 'importance' AS errors FROM memory_item WHERE importance * 1.5 > 1",
    "embedding_dim_stats": "SELECT count(*) AS n, round(avg(dim), 5) AS avg_dim, min(dim) AS min_dim, max(dim) AS max_dim, count(DISTINCT dim) AS dims FROM memory_embedding",
    "embedding_dim_hist": "SELECT dim, count(*) AS n, min(memory_id) AS first_id, max(memory_id) AS last_id FROM memory_embedding GROUP BY dim",
    "embedding_model_stats": "SELECT model, count(*) AS n, round(avg(dim), 5) AS avg_dim FROM memory_embedding GROUP BY model",
    "embedding_invalid": "SELECT memory_id, dim, CASE WHEN dim = 0 THEN 'empty' WHEN dim > 1536 THEN 'too_long' ELSE 'unexpected' END AS fault FROM memory_embedding WHERE dim <> 512",
    "connectivity_stats": "SELECT (SELECT count(*) FROM memory_item) AS items, (SELECT count(*) FROM memory_embedding) AS embeddings, (SELECT count(*) FROM memory_item WHERE id NOT IN (SELECT memory_id FROM memory_embedding)) AS without_embedding",
    "feedback_recent": "SELECT event, row_number() OVER (PARTITION BY event ORDER BY created_at DESC, event_id DESC)::INT AS n, memory_id, event_id, score FROM feedback_event WHERE event IN ('helpful', 'edited', 'neglected') QUALIFY n <= 10",
    "constraint_violations": """SELECT 'type' AS rule, 0::BIGINT AS n UNION ALL SELECT 'content', 0 UNION ALL SELECT 'importance', 0 UNION ALL SELECT 'privacy_scope', 0 UNION ALL SELECT 'duplicate_id', 0 UNION ALL SELECT 'embedding_unique', 0 UNION ALL SELECT 'relation_type', 0 UNION ALL SELECT 'feedback_event', 0
      UNION ALL SELECT 'embedding_memory', count(*) FROM memory_embedding WHERE memory_id NOT IN (SELECT id FROM memory_item)
      UNION ALL SELECT 'link_source', count(*) FROM memory_link WHERE source_id NOT IN (SELECT id FROM memory_item) UNION ALL SELECT 'link_target', count(*) FROM memory_link WHERE target_id NOT IN (SELECT id FROM memory_item)
      UNION ALL SELECT 'feedback_memory', count(*) FROM feedback_event WHERE memory_id NOT IN (SELECT id FROM memory_item)""",
    "query_latency": "SELECT n, min(time_ms) AS least, max(time_ms) AS most, round(avg(time_ms), 5) AS mean, max(time_ms) FILTER (r = floor(n * 0.5::DOUBLE)) AS median, round(max(time_ms) FILTER (r = floor(n * 0.95::DOUBLE)), 5) AS p95 FROM (SELECT time_ms, count(*) OVER () AS n, row_number() OVER (ORDER BY time_ms) - 1 AS r FROM query_log) GROUP BY n",
    "metric_latency": "SELECT metric, n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 5) AS mean, round(max(value) FILTER (r = floor(n * 0.5::DOUBLE)), 6) AS median, round(max(value) FILTER (r = floor(n * 0.95::DOUBLE)), 5) AS p95 FROM (SELECT metric, value, count(*) OVER (PARTITION BY metric) AS n, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS r FROM metric_stream) GROUP BY metric, n",
    "embedding_dim_ids": "SELECT dim, part, count(*) AS n, string_agg(memory_id, ',' ORDER BY memory_id) AS ids FROM (SELECT dim, memory_id, (row_number() OVER (PARTITION BY dim ORDER BY memory_id) - 1) // 100 AS part FROM memory_embedding) GROUP BY dim, part",
    "group_by_type": "SELECT type, part, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT type, id, (row_number() OVER (PARTITION BY type ORDER BY id) - 1) // 100 AS part FROM memory_item) GROUP BY type, part",
    "group_by_scope": "SELECT privacy_scope, part, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT privacy_scope, id, (row_number() OVER (PARTITION BY privacy_scope ORDER BY id) - 1) // 100 AS part FROM memory_item) GROUP BY privacy_scope, part",
    "catalog_columns": """SELECT table_name, n, unnest(string_split(names, ' ')) AS column_name, unnest(string_split(kinds, ' ')) AS data_type FROM (
      SELECT 'memory_item' AS table_name, count(*) AS n, 'id type content importance privacy_scope created_at last_accessed pinned tags source view_count cite_count edit_count' AS names, 'string string string double string timestamp timestamp boolean array<string> string bigint bigint bigint' AS kinds FROM memory_item
      UNION ALL SELECT 'memory_embedding', count(*), 'memory_id embedding dim model created_at', 'string array<double> int string timestamp' FROM memory_embedding
      UNION ALL SELECT 'memory_link', count(*), 'source_id target_id relation_type', 'string string string' FROM memory_link)""",
    "forget_ranking": "SELECT id, forget_score FROM features ORDER BY forget_score DESC, id LIMIT 100",
    "unpin_and_forget_feedback": f"SELECT id AS memory_id, 'edited' AS event, 0.0::DOUBLE AS score, {AS_OF} AS created_at FROM memory_item WHERE n % 17 = 0 AND pinned AND importance <= 0.8 UNION ALL SELECT id, 'neglected', 0.0, {AS_OF} FROM memory_item WHERE n % 3 = 0 AND NOT pinned",
    "vector_hits_with_metadata": "SELECT query_id, rank, id, type, importance, created_at, content, pinned, last_accessed, array_to_string(tags, ',') AS tags, source, privacy_scope, similarity AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS rank FROM vector_pairs WHERE similarity >= 0.15 QUALIFY rank <= 5) v JOIN memory_item m ON m.id = v.memory_id",
    "compressed_search": "SELECT query_id, id, score, original_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, importance AS score, count(*) OVER (PARTITION BY query_id) AS original_count FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS k FROM bm25 QUALIFY k <= 15) JOIN memory_item USING (id)) QUALIFY rank <= 10",
    "relevance_full": f"SELECT id, round(CASE WHEN content = '' THEN 0.0::DOUBLE ELSE 0.6::DOUBLE * list_dot_product(embedding, list_reverse(embedding)) / list_dot_product(embedding, embedding) + 0.3::DOUBLE * {bm25_simple("'the of tion tion'", 'content')} + 0.05::DOUBLE * {tag_match("'the of tion tion'", 'tags')} + 0.05::DOUBLE * {TITLE} END, 6) AS value FROM (SELECT *, {words('content')} AS cw FROM memory_item JOIN (SELECT memory_id AS id, embedding FROM memory_embedding) USING (id))",
    "performance_summary": """SELECT metric, current, trend, coalesce(active, 0) AS active, coalesce(total, 0) AS total FROM (SELECT metric, round(max_by(value, (ts, id)), 6) AS current FROM metric_stream GROUP BY metric) JOIN (
      SELECT metric, CASE WHEN points < 2 OR first = 0 THEN 'stable' WHEN (last - first) / first > 0.1 THEN 'increasing' WHEN (last - first) / first < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT metric, max_by(value, n) AS first, min_by(value, n) AS last, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, id DESC) AS n FROM metric_stream) WHERE n <= 10 GROUP BY metric)) USING (metric)
      LEFT JOIN (SELECT metric, count(*) FILTER (NOT resolved) AS active, count(*) AS total FROM alert_log GROUP BY metric) USING (metric)""",
    "index_after_changes": "SELECT id, term, tf, dl FROM changed_postings JOIN changed_lengths USING (id)",
    "search_index_status": "SELECT true AS available, true AS table_exists, (SELECT count(*) FROM lengths) AS record_count, (SELECT round(avg(dl), 5) FROM lengths) AS mean, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS tokens FROM postings",
    "vector_index_status": "SELECT true AS available, true AS table_exists, count(*) AS record_count, 64 AS dimensions FROM embedded",
    "create_batch": """SELECT id, concat_ws(',', nullif(concat_ws(',', CASE WHEN content IS NULL OR content = '' THEN 'content' END, CASE WHEN n % 7 = 0 THEN 'type' END, CASE WHEN importance > 1 THEN 'importance' END, CASE WHEN n % 17 = 0 THEN 'privacy_scope' END), ''),
      CASE WHEN again > 1 THEN 'repeated' END, CASE WHEN n < 50 THEN 'exists' END) AS errors, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY content NULLS FIRST) AS again FROM (
        SELECT id, n, CASE WHEN n % 11 = 0 THEN importance * 5 ELSE importance END AS importance, CASE WHEN n % 13 = 0 THEN '' WHEN n % 26 = 1 THEN NULL ELSE content END AS content FROM memory_item
        UNION ALL SELECT id, n, CASE WHEN n % 11 = 0 THEN importance * 5 ELSE importance END, '~ ' || CASE WHEN n % 13 = 0 THEN '' WHEN n % 26 = 1 THEN NULL ELSE content END FROM memory_item WHERE n % 19 = 0)) GROUP BY 1, 2""",
    "json_round_trip": "SELECT id, type, importance, pinned, created_at, array_to_string(tags, ',') AS tags, length(content) AS length FROM memory_item",
    "tags_parse": "SELECT id, CASE WHEN n % 5 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags FROM memory_item",
    "index_advice": """SELECT "table", columns, kind, sum(n)::BIGINT AS n, round(sum(time_ms), 4) AS time_ms, CASE WHEN kind = 'combined' OR sum(n) > 50 THEN 'high' ELSE 'medium' END AS priority FROM (
      SELECT "table", unnest(conditions) AS columns, 'single' AS kind, n, time_ms FROM advised UNION ALL SELECT "table", array_to_string(list_sort(conditions), ','), 'pair', n, time_ms FROM advised WHERE len(conditions) = 2
      UNION ALL SELECT "table", array_to_string(list_concat(conditions, ordered), ','), 'combined', n, time_ms FROM advised WHERE len(conditions) + len(ordered) > 1 AND time_ms > 1000) GROUP BY "table", columns, kind HAVING kind = 'combined' OR sum(n) > 10""",
    "monitor_until_resolved": """SELECT id, metric, ts FROM (SELECT *, count(*) FILTER (resolve) OVER (PARTITION BY metric ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM (SELECT *, id % 29 = 0 AS resolve FROM metric_stream WHERE id % 29 = 0 OR value > 80))
      WHERE NOT resolve QUALIFY row_number() OVER (PARTITION BY metric, segment ORDER BY ts, id) = 1""",
    "monitoring_cycle": "SELECT ts, metric, round(value, 6) AS value FROM cycle_metrics",
    "cycle_alerts": "SELECT epoch(ts)::BIGINT AS id, metric, level, round(value, 6) AS value FROM cycle_metrics JOIN thresholds USING (metric) WHERE CASE WHEN op = 'gt' THEN value > threshold ELSE value < threshold END",
    "pin_next_version": f"SELECT id, pinned OR n % 4 = 0 AS pinned, CASE WHEN NOT pinned AND n % 4 = 0 THEN {AS_OF} ELSE last_accessed END AS last_accessed FROM memory_item",
    "hard_delete_cascade": "SELECT 'memory_item' AS table_name, count(*) AS n FROM memory_item WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'memory_embedding', count(*) FROM memory_embedding WHERE memory_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'memory_link', count(*) FROM memory_link WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'feedback_event', count(*) FROM feedback_event WHERE memory_id NOT IN (SELECT id FROM gone)",
    "change_tags": "SELECT id, array_to_string(list_filter(CASE WHEN tags[1] = 'en' THEN [tags[1], tags[2], 'new'] ELSE [tags[1], tags[2], 'new', 'en'] END, lambda t: t <> 'src1'), ',') AS tags FROM memory_item",
    "upsert_embedding": "SELECT memory_id, CASE WHEN n % 2 = 0 THEN 'model_new' ELSE model END AS model, created_at FROM memory_embedding",
    "update_memories": "SELECT id, type, CASE WHEN type = 'working' THEN 0.9 ELSE importance END::DOUBLE AS importance FROM memory_item UNION ALL SELECT 'mem_new', NULL, 0.4",
    "link_dedup": "SELECT relation_type, count(*) AS n FROM memory_link GROUP BY relation_type",
    "memory_links": "SELECT source_id AS id, part, '' AS cause_of, coalesce(string_agg(target_id, ',' ORDER BY target_id) FILTER (relation_type = 'derived_from'), '') AS derived_from, coalesce(string_agg(target_id, ',' ORDER BY target_id) FILTER (relation_type = 'duplicates'), '') AS duplicates, '' AS contradicts FROM (SELECT *, (row_number() OVER (PARTITION BY source_id, relation_type ORDER BY target_id) - 1) // 1000 AS part FROM memory_link) GROUP BY source_id, part",
    "tag_bridge": "SELECT id AS memory_id, (dense_rank() OVER (ORDER BY tag))::INT AS tag_id, tag AS name FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM memory_item)",
    "feedback_append": f"SELECT id AS memory_id, CASE WHEN importance > 0.5 THEN 'helpful' ELSE 'not_helpful' END AS event, importance AS score, {AS_OF} AS created_at FROM memory_item WHERE pinned",
    "working_ttl_cleanup": f"SELECT id, created_at FROM memory_item WHERE type = 'working' AND NOT pinned AND created_at < {AS_OF} - INTERVAL 2 DAYS",
    "export_csv": """SELECT id, concat_ws(',', id, '"' || replace(content, '"', '""') || '"', type, printf('%.1f', importance), strftime(created_at, '%Y-%m-%d %H:%M:%S'), coalesce(strftime(last_accessed, '%Y-%m-%d %H:%M:%S'), ''), pinned::VARCHAR, array_to_string(tags, ';'), privacy_scope, source) AS line FROM memory_item""",
    "export_markdown": """SELECT id, '## ' || CASE type WHEN 'working' THEN '⚡' WHEN 'episodic' THEN '📅' WHEN 'semantic' THEN '🧠' ELSE '🔧' END || ' ' || id || chr(10) || chr(10) || '**내용**: ' || content || chr(10) || chr(10) || '**타입**: ' || type || chr(10)
      || '**중요도**: ' || repeat('★', round(importance * 5)::INT) || repeat('☆', 5 - round(importance * 5)::INT) || printf(' (%.1f)', importance) || chr(10) || '**생성일**: ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || chr(10)
      || CASE WHEN last_accessed IS NOT NULL THEN '**마지막 접근**: ' || strftime(last_accessed, '%Y-%m-%d %H:%M:%S') || chr(10) ELSE '' END || '**태그**: #' || tags[1] || ' #' || tags[2] || chr(10) || '**공개 범위**: ' || privacy_scope || chr(10)
      || CASE WHEN pinned THEN '**고정됨**: ✅' || chr(10) ELSE '' END || chr(10) || '---' || chr(10) || chr(10) AS section FROM memory_item""",
    "errors_by_hour": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM error_log GROUP BY 1",
    "errors_by_severity": f"SELECT severity, count(id) AS n FROM (SELECT unnest({_list(SEVERITIES)}) AS severity) LEFT JOIN error_log USING (severity) GROUP BY severity",
    "errors_by_category": f"SELECT category, count(id) AS n FROM (SELECT unnest({_list(CATEGORIES)}) AS category) LEFT JOIN error_log USING (category) GROUP BY category",
    "error_resolution": "SELECT count(*) AS total, count(*) FILTER (resolved) AS resolved, round(avg((epoch_us(resolved_at) - epoch_us(ts)) / 1000.0), 4) AS avg_resolution_ms FROM error_log",
    "error_search": "SELECT id, ts, category FROM error_log WHERE severity = 'high' AND ts >= TIMESTAMP '2024-01-10' AND NOT resolved ORDER BY ts DESC, id DESC LIMIT 20",
    "error_threshold_alerts": "SELECT * FROM (SELECT id, severity, count(*) OVER (PARTITION BY severity ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM error_log) WHERE n >= CASE severity WHEN 'critical' THEN 1 ELSE 2 END",
    "alert_thresholds": "SELECT id, metric, level, value, threshold FROM alerts",
    "alert_counts": "SELECT metric, level, count(*) AS n FROM alerts GROUP BY metric, level",
    "monitor_alerts": "SELECT metric, date_trunc('day', ts)::TIMESTAMP AS day, id, round(value, 6) AS value, CASE WHEN value > 90 THEN 'critical' ELSE 'warning' END AS severity FROM metric_stream WHERE value > 80 QUALIFY row_number() OVER (PARTITION BY metric, date_trunc('day', ts) ORDER BY ts, id) = 1",
    "metric_trend": "SELECT metric, round(first, 6) AS first, round(last, 6) AS last, CASE WHEN points < 2 OR first = 0 THEN 'stable' WHEN (last - first) / first > 0.1 THEN 'increasing' WHEN (last - first) / first < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT metric, max_by(value, n) AS first, min_by(value, n) AS last, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, id DESC) AS n FROM metric_stream) WHERE n <= 10 GROUP BY metric)",
    "alert_stats_level": f"SELECT level, count(id) AS n FROM (SELECT unnest({_list(LEVELS)}) AS level) LEFT JOIN (SELECT * FROM alert_log WHERE ts >= {AS_OF} - INTERVAL 480 HOURS) USING (level) GROUP BY level",
    "alert_stats_metric": f"SELECT metric, count(id) AS n FROM (SELECT unnest({_list(METRICS)}) AS metric) LEFT JOIN (SELECT * FROM alert_log WHERE ts >= {AS_OF} - INTERVAL 480 HOURS) USING (metric) GROUP BY metric",
    "alert_summary": "SELECT count(*) AS total, count(*) FILTER (NOT resolved) AS active, count(*) FILTER (resolved) AS resolved, coalesce(round(avg((epoch_us(resolved_at) - epoch_us(ts)) / 1000.0), 4), 0.0) AS avg_resolution_ms FROM alert_log",
    "alert_search": "SELECT id, ts, metric, level FROM alert_log WHERE level = 'critical' AND NOT resolved AND ts >= TIMESTAMP '2024-01-05'",
    "alert_cleanup": f"SELECT id, metric, level, resolved FROM alert_log WHERE NOT (resolved AND ts < {AS_OF} - INTERVAL 240 HOURS)",
    "monitor_rules": f"SELECT metric, date_trunc('day', ts)::TIMESTAMP AS day, id, round(value, 6) AS value, CASE WHEN value > critical THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT id, ts, ['memory', 'cpu', 'database', 'query'][id % 4 + 1] AS metric, value * [1.0, 1.0, 2.0, 25.0][id % 4 + 1]::DOUBLE AS value FROM metric_stream) JOIN (VALUES {_values(MONITOR_RULES)}) r(metric, least, critical) USING (metric) WHERE value > least QUALIFY row_number() OVER (PARTITION BY metric, date_trunc('day', ts) ORDER BY ts, id) = 1",
    "latest_error_state": "SELECT category, id AS seq, severity, resolved FROM error_log QUALIFY row_number() OVER (PARTITION BY category ORDER BY ts DESC, id DESC) = 1",
    "tool_metrics": "SELECT 'tool_' || (item_id % 5) AS tool, count(*) AS executions, count(*) FILTER (item_id % 7 <> 0) AS successes, round(count(*) FILTER (item_id % 7 = 0) / count(*)::DOUBLE, 6) AS error_rate, round(avg(time_ms), 5) AS mean_ms FROM query_log GROUP BY 1",
    "tool_categories": "SELECT DISTINCT name, CASE WHEN regexp_matches(name, 'memory|remember|recall') THEN 'memory' WHEN regexp_matches(name, 'search|find') THEN 'search' WHEN regexp_matches(name, 'cleanup|forget') THEN 'maintenance' WHEN regexp_matches(name, 'performance|monitor') THEN 'monitoring' ELSE 'other' END AS category FROM tools",
    "tool_search": "SELECT * FROM tools WHERE contains(lower(name), 'me') OR contains(lower(description), 'me')",
    "query_errors": f"SELECT id, CASE WHEN content IS NULL OR regexp_replace(content, '{WHITE}', '', 'g') = '' THEN 'empty' WHEN length(content) > 1000 THEN 'too_long' WHEN regexp_matches(lower(content), '<script|javascript:|on[a-z0-9_]+[ \\t\\n\\r]*=') THEN 'forbidden' ELSE '' END AS error FROM memory_item",
    "rank_bm25_share": value("importance * 10 / (importance * 10 + 2.0::DOUBLE)"),
    "rank_score_between": value("greatest(0.0::DOUBLE, least(1.0::DOUBLE, (importance - 0.2::DOUBLE) / (0.7::DOUBLE - 0.2::DOUBLE)))"),
    "rank_usage_by_access": value(f"coalesce(exp(-{age('last_accessed')}::DOUBLE / 30), 0.1::DOUBLE)"),
    "rank_relevance_simple": f"SELECT id, round(CASE WHEN content = '' THEN 0.0::DOUBLE ELSE 0.3::DOUBLE * {bm25_simple("'the of tion tion'", 'content')} + 0.05::DOUBLE * {tag_match("'the of tion tion'", 'tags')} END, 6) AS value FROM (SELECT *, {words('content')} AS cw FROM memory_item)",
    "rank_first_score": value("coalesce(nullif(importance * (view_count % 2), 0), nullif(importance / 2, 0), 0.0::DOUBLE)"),
    "rank_vector_share": value("CASE WHEN view_count + cite_count > 0 THEN view_count / (view_count + cite_count)::DOUBLE ELSE 0.6::DOUBLE END"),
    "truncated_length": value("length(substr(content, 1, 100))::DOUBLE"),
    "type_defaults": f"SELECT id, type, default_importance::DOUBLE AS default_importance, default_scope, ttl_days::INT AS ttl_days FROM memory_item LEFT JOIN (VALUES {_values([['NULL' if x is None else x for x in r] for r in TYPE_DEFAULTS]).replace(chr(39) + 'NULL' + chr(39), 'NULL')}) t(type, default_importance, default_scope, ttl_days) USING (type)",
    "table_counts": "SELECT 'memory_item' AS table_name, count(*) AS n, 13 AS n_columns FROM memory_item UNION ALL SELECT 'memory_embedding', count(*), 5 FROM memory_embedding UNION ALL SELECT 'memory_link', count(*), 3 FROM memory_link",
    "embedding_backup": "SELECT memory_id, type, content, dim, model FROM memory_embedding e JOIN memory_item m ON m.id = e.memory_id",
    "cosine_all": "SELECT e.memory_id, CASE WHEN n % 2 = 1 THEN 0.0 ELSE greatest(0.0, round(list_dot_product(vector, embedding) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(embedding, embedding))), 6)) END AS similarity FROM embedded e, (SELECT list(x ORDER BY i) AS vector FROM (SELECT i, round(avg(embedding[i]), 6) AS x FROM embedded, range(1, 65) t(i) GROUP BY i)) v",
    "command_feedback": f"SELECT id AS memory_id, 'helpful' AS event, 3.0::DOUBLE AS score, {AS_OF} AS created_at FROM memory_item WHERE n % 4 = 0 AND NOT pinned",
    "wm_expired": f"SELECT session_id, expires_at FROM wm_buffer WHERE expires_at <= {AS_OF}",
    "wm_snapshot": f"SELECT 'mem_wm_' || session_id AS id, 'episodic' AS type, content, {AS_OF} AS created_at FROM wm_buffer WHERE expires_at <= {AS_OF}",
    "query_slow_topk": "SELECT query, count(*) AS runs, round(avg(time_ms), 5) AS avg_ms FROM query_log GROUP BY query HAVING round(avg(time_ms), 5) > 50 ORDER BY avg_ms DESC, query LIMIT 10",
    "newest_errors": "SELECT id, severity, ts FROM error_log QUALIFY row_number() OVER (PARTITION BY severity ORDER BY ts DESC, id DESC) <= 5",
    "query_complexity": "SELECT query, CASE WHEN p <= 1 THEN 'simple' WHEN p <= 3 THEN 'medium' ELSE 'complex' END AS complexity FROM (SELECT DISTINCT query, 2 * contains(query, 'JOIN')::INT + contains(query, 'GROUP BY')::INT + contains(query, 'ORDER BY')::INT + contains(query, 'HAVING')::INT + 2 * contains(query, 'UNION')::INT + 2 * (len(regexp_extract_all(query, 'SELECT')) > 1)::INT AS p FROM sql_log)",
    "query_pattern_freq": "SELECT column_name, sum(n)::BIGINT AS n, CASE WHEN sum(n) > 50 THEN 'high' WHEN sum(n) > 10 THEN 'medium' ELSE 'low' END AS priority FROM (SELECT DISTINCT query, n, unnest(regexp_extract_all(query, '(?:WHERE|AND|OR)\\s+([a-zA-Z_.]+)\\s*(?:=|<|>|IN|LIKE)', 1)) AS column_name FROM (SELECT query, count(*) AS n FROM sql_log GROUP BY query)) GROUP BY column_name",
    "extract_tags": "SELECT id, array_to_string(list_concat(list_concat(regexp_extract_all(content, '#([A-Za-z0-9_가-힣]+)', 1), regexp_extract_all(content, '@([A-Za-z0-9_가-힣]+)', 1)), regexp_extract_all(content, '([A-Za-z0-9_가-힣]+):', 1)), ',') AS tags FROM memory_item",
    "token_estimate": "SELECT id, ceil(length(content) / 4)::BIGINT AS quarter, (ceil(round(len(regexp_extract_all(content, '[a-zA-Z]+')) * 1.3, 9)) + length(regexp_replace(content, '[a-zA-Z]', '', 'g')))::BIGINT AS mixed FROM memory_item",
    "relative_time": f"SELECT id, CASE WHEN h >= 24 THEN (h // 24) || '일 전' WHEN h > 0 THEN h || '시간 전' ELSE '방금 전' END AS ago FROM (SELECT id, ((epoch_us({AS_OF}) - epoch_us(created_at)) // 3600000000)::BIGINT AS h FROM memory_item)",
    "summarize_200": """SELECT id, CASE WHEN length(content) <= 200 THEN content WHEN taken = 0 THEN substr(content, 1, 200) || '...' ELSE array_to_string(s[1:taken], '.') || '.' END AS summary FROM (
      SELECT id, content, s, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda k: list_bool_and(list_transform(range(1, k + 1), lambda j: coalesce(list_sum(list_transform(s[1:j - 1], lambda x: length(x) + 1)), 0) + length(s[j]) <= 200)))), 0) AS taken
      FROM (SELECT id, content, regexp_split_to_array(content, '[.!?]+')[1:250] AS s FROM memory_item))""",
    "format_bytes": "SELECT id, CASE WHEN b = 0 THEN '0 B' ELSE regexp_replace(printf('%.2f', round(b / pow(1024.0, p), 2)), '\\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS shown FROM (SELECT id, b, floor(ln(b) / ln(1024.0::DOUBLE))::INT AS p FROM (SELECT id, length(content)::DOUBLE * 1000 AS b FROM memory_item))",
}


def batch_result(status: str, step: int) -> str:
    return f"""SELECT batch, status, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM (SELECT c.id, c.i // 100 AS batch, CASE WHEN m.id IS NULL THEN 'not_found' {status} END AS status FROM (
  SELECT 'mem_' || n AS id, n AS i FROM memory_item WHERE n % {step} = 0 UNION ALL SELECT 'mem_x' || n, n FROM memory_item WHERE n % 100 = 0) c LEFT JOIN memory_item m ON m.id = c.id) GROUP BY batch, status"""


def summarised(source: str) -> str:
    """The rows of a source (with text and budget) and their summary of so many tokens."""
    strip = "regexp_replace({}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
    return f"""SELECT *, CASE WHEN len(words) <= most THEN text WHEN n_s <= 2 THEN array_to_string(words[1:greatest(most, 0)], ' ') || '...'
    ELSE long || CASE WHEN length(long) < length(text) THEN '...' ELSE '' END END AS summary FROM (
  SELECT *, first || CASE WHEN take > 0 THEN ' ' || array_to_string(middle[1:take], ' ') ELSE '' END || CASE WHEN rest - take > 0 THEN ' ' || last ELSE '' END AS long FROM (
    SELECT *, greatest(0, CASE WHEN rest > 0 AND n_s > 2 THEN least(rest - len(string_split(last, ' ')), len(middle)) ELSE 0 END) AS take FROM (
      SELECT *, most - len(string_split(first, ' ')) AS rest, string_split(array_to_string(s[2:n_s - 1], '. '), ' ') AS middle FROM (
        SELECT *, len(s) AS n_s, {strip.format('s[1]')} AS first, {strip.format('s[len(s)]')} AS last FROM (
          SELECT *, string_split(text, ' ') AS words, floor(round(budget / 1.5, 9))::INT AS most,
            list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '{WHITE}', ' ', 'g')) <> '') AS s FROM ({source}))))))"""


def shortened(source: str) -> str:
    """The rows of a source (with content) and its summary of 200 characters as short."""
    return f"""SELECT *, CASE WHEN length(content) <= 200 THEN content WHEN taken = 0 THEN substr(content, 1, 200) || '...' ELSE array_to_string(s[1:taken], '.') || '.' END AS short FROM (
  SELECT *, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda k: list_bool_and(list_transform(range(1, k + 1), lambda j: coalesce(list_sum(list_transform(s[1:j - 1], lambda x: length(x) + 1)), 0) + length(s[j]) <= 200)))), 0) AS taken
  FROM (SELECT *, regexp_split_to_array(content, '[.!?]+')[1:250] AS s FROM ({source})))"""


def mixed_tokens(x: str) -> str:
    return f"(length(regexp_replace({x}, '[^가-힣]', '', 'g')) + ceil(round(len(regexp_extract_all({x}, '[a-zA-Z]+')) * 1.3, 9)) + length(regexp_replace({x}, '[a-zA-Z가-힣]', '', 'g')))::BIGINT"


def folded(key: str, limit: str) -> str:
    """Common table fold over items (key, n, id, text, tokens, short, short_tokens): what fits goes in, whole or short."""
    whole, brief = f"f.used + i.tokens <= {limit}", f"f.used + i.short_tokens <= {limit}"
    return f"""fold AS (SELECT {key}, 0::BIGINT AS n, 0::BIGINT AS used, false AS taken, NULL::VARCHAR AS id, NULL::VARCHAR AS text, 0::BIGINT AS tokens FROM (SELECT DISTINCT {key} FROM items)
  UNION ALL SELECT i.{key}, i.n, f.used + CASE WHEN {whole} THEN i.tokens WHEN {brief} THEN i.short_tokens ELSE 0 END, {whole} OR {brief}, i.id, CASE WHEN {whole} THEN i.text ELSE i.short END, CASE WHEN {whole} THEN i.tokens ELSE i.short_tokens END
  FROM fold f JOIN items i ON i.{key} = f.{key} AND i.n = f.n + 1)"""


def contexts() -> dict[str, str]:
    """Summaries and greedy choices under a budget."""
    best = "(SELECT query_id, id, content, row_number() OVER (PARTITION BY query_id ORDER BY round(round(score, 5) + importance, 6) DESC, id) AS n FROM ranked QUALIFY n <= {})"
    hits = text_search("importance >= 0.5", 10, "constant")
    chosen = "SELECT {0}, row_number() OVER (PARTITION BY {0} ORDER BY n)::INT AS position, id, text, tokens FROM fold WHERE taken"
    recursive = lambda q: q.replace("WITH ", "WITH RECURSIVE ", 1)
    items = f"items AS (SELECT query_id, n, id, summary AS text, ceil(length(summary) / 4)::BIGINT AS tokens, '' AS short, 1000000000::BIGINT AS short_tokens FROM ({summarised('SELECT query_id, n, id, content AS text, 80 AS budget FROM ' + best.format(5))}))"
    inject = f"{hits}, {items}, {folded('query_id', '400')}"
    out = {"inject_budget_fold": recursive(sql(chosen.format("query_id"), inject))}
    section = """'## ' || position || '. ' || CASE type WHEN 'working' THEN '🧠' WHEN 'episodic' THEN '📝' WHEN 'semantic' THEN '📚' ELSE '⚙️' END || ' ' || upper(type) || ' 기억' || chr(10) || '**중요도**: ' || repeat('★', ceil(round(importance * 5, 9))::INT)
      || printf(' (%.2f)', importance) || chr(10) || '**내용**: ' || text || chr(10) || chr(10)"""
    body = f"""SELECT query_id, CASE WHEN count(id) = 0 THEN '관련 기억을 찾을 수 없습니다.' ELSE '# 관련 기억 (' || count(id) || '개)' || chr(10) || chr(10) || '**검색 쿼리**: "' || any_value(query) || '"' || chr(10) || chr(10) || string_agg({section}, '' ORDER BY position)
      || '---' || chr(10) || '*이 기억들은 현재 대화와 관련된 맥락 정보입니다. 참고하여 더 정확하고 관련성 높은 답변을 제공하세요.*' END AS prompt
      FROM queries LEFT JOIN (SELECT p.*, m.type, m.importance FROM ({chosen.format("query_id")}) p JOIN memory_item m USING (id)) USING (query_id) GROUP BY query_id"""
    out["inject_prompt"] = recursive(sql(body, inject))
    both = shortened(f"SELECT query_id, n, id, content FROM {best.format(10)}")
    items = f"items AS (SELECT query_id, n, id, content AS text, {mixed_tokens('content')} AS tokens, short, {mixed_tokens('short')} AS short_tokens FROM ({both}))"
    out["context_compress"] = recursive(sql(chosen.format("query_id"), f"{hits}, {items}, {folded('query_id', '1200')}"))
    items = "items AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, turn::VARCHAR AS id, coalesce(text, '') AS text, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens, '' AS short, 1000000000::BIGINT AS short_tokens FROM conversations)"
    out["wm_buffer_budget"] = recursive(sql(chosen.format("session_id"), f"{items}, {folded('session_id', '300')}"))
    out["budget_summary"] = sql(f"SELECT id, summary FROM ({summarised('SELECT id, content AS text, 60 AS budget FROM memory_item')})")
    return out


REASON = """CASE WHEN score IS NULL THEN '벡터 유사도: ' || printf('%.3f', round(similarity + 1e-9, 3)) WHEN similarity IS NULL THEN '텍스트 검색 결과'
    ELSE coalesce(nullif(concat_ws(', ', CASE WHEN score > 0.7 THEN '텍스트 매칭' END, CASE WHEN similarity > 0.8 THEN '벡터 유사도' END, CASE WHEN score > 0.5 AND similarity > 0.5 THEN '하이브리드 매칭' END), ''), '하이브리드 검색 결과') END"""


def hybrid(where: str) -> str:
    """Common tables of a hybrid search under one set of filters."""
    return f"""{text_search(where, 20, "constant")},
near AS (SELECT query_id, memory_id AS id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS k FROM vector_pairs JOIN memory_item m ON m.id = memory_id WHERE {where} AND similarity >= 0.15 QUALIFY k <= 20),
hybrid AS (SELECT query_id, id, coalesce(score, 0.0) AS text_score, coalesce(similarity, 0.0) AS vector_score, round(coalesce(score, 0.0) * text_weight + coalesce(similarity, 0.0) * vector_weight + 1e-9, 6) AS final_score, {REASON} AS recall_reason
  FROM ranked FULL JOIN near USING (query_id, id) JOIN weights USING (query_id))"""


def hybrids() -> dict[str, str]:
    """Searches that join both arms."""
    out = {"hybrid_topk": sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank, id, text_score, vector_score, final_score, recall_reason FROM hybrid QUALIFY rank <= 10", hybrid(SOME), ASKED)}
    out["recall_without_metadata"] = sql("SELECT query_id, id, rank, final_score, type, importance, created_at, '' AS content FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS rank, id, final_score FROM hybrid QUALIFY rank <= 10) JOIN memory_item USING (id)", hybrid(SOME), ASKED)
    # Weights .7 and .3 before they are adapted.
    cases = "CASE WHEN technical THEN {} WHEN phrase THEN {} WHEN short THEN {} ELSE {} END"
    heavy = TABLES["weights"].replace(cases.format(0.8, 0.4, 0.7, 0.6), cases.format(0.8, 0.7 - 0.2, 0.7, 0.7)).replace(cases.format(0.2, 0.4 + 0.2, 0.4 - 0.1, 0.4), cases.format(0.2, 0.3 + 0.2, 0.3, 0.3))
    best = """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score + importance, 6) DESC, id) AS n, id, content AS text, 80 AS budget FROM (
  SELECT h.*, m.content, m.importance FROM (SELECT * FROM hybrid QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) <= 10) h JOIN memory_item m USING (id)) QUALIFY n <= 5"""
    items = f"items AS (SELECT query_id, n, id, summary AS text, ceil(length(summary) / 4)::BIGINT AS tokens, '' AS short, 1000000000::BIGINT AS short_tokens FROM ({summarised(best)}))"
    chosen = sql("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n)::INT AS position, id, text, tokens FROM fold WHERE taken", f"{hybrid('importance >= 0.5')}, {items}, {folded('query_id', '400')}", ASKED | {"weights": heavy})
    out["inject_hybrid"] = chosen.replace("WITH ", "WITH RECURSIVE ", 1)
    weighted = "round(coalesce(vector_score, 0.0) * 0.6 + coalesce(text_score, 0.0) * 0.4 + 1e-9, 6)"
    out["vec_hybrid_topk"] = sql(
        f"""SELECT * FROM (SELECT query_id, id, {weighted} AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY {weighted} DESC, id) AS rank FROM (
      SELECT query_id, memory_id AS id, similarity AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS k FROM vector_pairs WHERE similarity >= 0 QUALIFY k <= 20)
      FULL JOIN (SELECT query_id, id, round(bm25 / (bm25 + 2.0::DOUBLE), 6) AS text_score FROM bm25) USING (query_id, id) QUALIFY rank <= 10) WHERE similarity >= 0.05""",
        over=ASKED,
    )
    usage = raw_usage()
    stages = f"""kept AS (SELECT * FROM memory_item WHERE {SOME}),
candidates AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, created_at DESC, id) AS k FROM bm25 JOIN kept USING (id) QUALIFY k <= 50)
  UNION SELECT query_id, id FROM (SELECT query_id, memory_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS k FROM vector_pairs JOIN kept m ON m.id = memory_id JOIN queries USING (query_id) WHERE similarity >= 0 QUALIFY k <= 50)),
cand AS (SELECT query_id, query, k.*, {words("content")} AS cw, embedding, coalesce(list_dot_product(vector, embedding) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(embedding, embedding))), 0.0) AS cosine
  FROM candidates JOIN kept k USING (id) JOIN queries USING (query_id) LEFT JOIN vectors USING (query_id) LEFT JOIN (SELECT memory_id AS id, embedding FROM embedded) e USING (id)),
scored AS (SELECT query_id, id, embedding, round(0.5::DOUBLE * relevance + 0.2::DOUBLE * recency + 0.2::DOUBLE * importance_score + 0.1::DOUBLE * usage, 6) AS score FROM (
  SELECT query_id, id, embedding, CASE WHEN query = '' OR content = '' THEN 0.0 ELSE 0.6::DOUBLE * cosine + 0.3::DOUBLE * {bm25_simple("query", "content")} + 0.05::DOUBLE * {tag_match("query", "tags")} END AS relevance, {recency()} AS recency, {IMPORTANCE} AS importance_score,
    CASE WHEN min({usage}) OVER q = max({usage}) OVER q THEN 0.5 ELSE ({usage} - min({usage}) OVER q) / (max({usage}) OVER q - min({usage}) OVER q + 1e-6) END AS usage FROM cand WINDOW q AS (PARTITION BY query_id)) WHERE score >= 0.35),
sims AS (SELECT a.query_id, a.id AS a, b.id AS b, round(list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) AS sim FROM scored a JOIN scored b ON a.query_id = b.query_id AND a.id <> b.id WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
picks AS (SELECT query_id, 1 AS rank, id, score, round(0.8::DOUBLE * score, 6) AS mmr, [id] AS chosen FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.8::DOUBLE * score, 6) DESC, id) = 1
  UNION ALL SELECT query_id, rank + 1, id, score, mmr, list_append(chosen, id) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mmr DESC, id) AS k FROM (
      SELECT p.query_id, p.rank, s.id, s.score, p.chosen, round(0.8::DOUBLE * s.score - 0.2::DOUBLE * greatest(0.0, coalesce(max(m.sim), 0.0)), 6) AS mmr FROM picks p JOIN scored s ON s.query_id = p.query_id AND NOT list_contains(p.chosen, s.id)
      LEFT JOIN sims m ON m.query_id = p.query_id AND m.a = s.id AND list_contains(p.chosen, m.b) WHERE p.rank < 10 GROUP BY p.query_id, p.rank, s.id, s.score, p.chosen)) WHERE k = 1)"""
    out["two_stage_recall"] = sql("SELECT query_id, rank, id, score, mmr FROM picks", stages, ASKED).replace("WITH ", "WITH RECURSIVE ", 1)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in CLEAN.items():
        if body.startswith("WITH RECURSIVE"):
            tables = sql(body[len("WITH RECURSIVE") :])
            out[name] = tables.replace("WITH ", "WITH RECURSIVE ", 1).replace(" steps AS", ", steps AS", 1)
        else:
            out[name] = sql(body, over=ASKED if name in ("tokens_clean", "adaptive_weights", "vec_text_outer_union", "compressed_search") else None)
    for name, where, limit, usage in (("text_search_batch", SOME, 10, "constant"), ("text_search_counters", "true", 5, "counters"), ("text_search_batch_usage", "true", 5, "batch")):
        out[name] = sql(RANKED, text_search(where, limit, usage))
    text = "texts AS (SELECT id, content FROM memory_item)"
    out["word_hash_bucket"] = _embed("SELECT word, hash, abs(hash) % 512 AS bucket, round(idf, 6) AS idf FROM word_hash", text)
    out["word_hash_base36"] = _embed("SELECT word, lower(to_base(abs(hash), 36)) AS hash FROM word_hash", text)
    out["embedding_swap"] = _embed("SELECT 'new' AS version, 512 AS dim, count(DISTINCT id) AS n, 0::BIGINT AS failed FROM cells UNION ALL SELECT 'new', 0, (SELECT count(*) FROM texts) - count(DISTINCT id), 0 FROM cells HAVING (SELECT count(*) FROM texts) > count(DISTINCT id) UNION ALL SELECT 'backup', 64, count(*), 0 FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)", text)
    out["embedding_rebuild"] = _embed("SELECT (SELECT count(*) FROM texts) AS memories, count(DISTINCT id) AS embedded, (SELECT count(*) FROM texts) - count(DISTINCT id) AS empty FROM cells", text)
    client = """(SELECT query_id, position, position || '. ' || CASE type WHEN 'working' THEN '⚡' WHEN 'episodic' THEN '📅' WHEN 'semantic' THEN '🧠' ELSE '🔧' END || ' ' || substr(content, 1, 80) || ' [' || tags[1] || ', ' || tags[2] || ']' || chr(10) || '   ' || repeat('★', round(importance * 5)::INT) || repeat('☆', 5 - round(importance * 5)::INT) || ' ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') AS s
      FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, id) AS position FROM bm25 QUALIFY position <= 3) JOIN memory_item USING (id))"""
    shown = f"""(SELECT query_id, CASE WHEN count(s) = 0 THEN '📋 관련 작업 기록이 없습니다.' || chr(10) || chr(10) || '💡 "' || any_value(query) || '"에 대해 새로운 정보로 답변해주세요.'
      ELSE '📋 관련 작업 기록:' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY position) || chr(10) || chr(10) || chr(10) || '💡 위의 ' || count(s) || '개 기억을 참고하여 "' || any_value(query) || '"에 대해 답변해주세요.' END AS content, count(s)::INT AS memories_used FROM queries LEFT JOIN {client} USING (query_id) GROUP BY query_id)"""
    out["context_client"] = sql(f"SELECT query_id, content, memories_used, (length(regexp_replace(content, '[^가-힣]', '', 'g')) + ceil(round(len(regexp_extract_all(content, '[a-zA-Z]+')) * 1.3, 9)) + length(regexp_replace(content, '[a-zA-Z가-힣]', '', 'g')))::BIGINT AS token_count FROM {shown}")
    out["light_embed_sparse"] = _embed("SELECT id, bucket, round(weight, 6) AS weight FROM cells", text)
    both = "texts AS (SELECT id, content FROM memory_item UNION ALL SELECT query_id, query FROM queries)"
    out["light_similarity_topk"] = _embed(top("(SELECT q.id AS query_id, d.id, round(sum(q.weight * d.weight), 6) AS similarity FROM cells d JOIN cells q USING (bucket) WHERE q.id IN (SELECT query_id FROM queries) AND d.id NOT IN (SELECT query_id FROM queries) GROUP BY q.id, d.id)", "query_id, id, similarity", "similarity DESC, id", 10), both)
    out |= hybrids()
    out["search_after_changes"] = sql(top("(SELECT query_id, id, round(bm25, 6) AS bm25 FROM changed_bm25)", "query_id, id, bm25", "bm25 DESC, id", 30), over=ASKED)
    out["vector_index_exact_topk"] = out["vector_topk_many"]
    cooled = """, kept AS (SELECT id, metric, level, ts, cooldown FROM alerts QUALIFY row_number() OVER (PARTITION BY metric, level ORDER BY ts, id) = 1
  UNION ALL SELECT id, metric, level, ts, cooldown FROM (SELECT a.*, row_number() OVER (PARTITION BY a.metric, a.level ORDER BY a.ts, a.id) AS n FROM kept k JOIN alerts a ON a.metric = k.metric AND a.level = k.level AND a.ts >= k.ts + to_seconds(k.cooldown)) WHERE n = 1)
SELECT id, metric, level FROM kept"""
    head = sql("SELECT id, metric, level FROM alerts")
    out["alert_cooldown"] = head[: head.rindex(" SELECT id, metric")].replace("WITH ", "WITH RECURSIVE ", 1) + cooled
    out |= contexts()
    out["pin_batch"] = sql(batch_result("WHEN pinned THEN 'already_pinned' ELSE 'pinned'", 4))
    out["unpin_batch"] = sql(batch_result("WHEN NOT pinned THEN 'already_unpinned' WHEN importance > 0.8 THEN 'requires_confirmation' ELSE 'unpinned'", 17))
    out["forget_batch"] = sql(batch_result("WHEN pinned THEN 'pinned' ELSE 'soft_deleted'", 3))
    return out


def _embed(body: str, texts: str) -> str:
    names = ("embed_words", "word_hash", "word_stats", "cells")
    tables = ", ".join([*_with(texts), texts, *(f"{n} AS ({TABLES[n]})" for n in names)])
    return f"WITH {tables} {body}"


def _with(text: str) -> list[str]:
    """The common tables that a text names, in order."""
    needed = []
    for name in ("used", "memory_item", "queries"):
        if re.search(rf"(?<![\w.]){name}(?!\w)", text) or name == "used":
            needed.append(f"{name} AS ({TABLES[name]})")
    return needed
