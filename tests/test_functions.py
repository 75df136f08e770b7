"""Closed-form cases of the functions and the operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.config import AS_OF
from recollect.functions import scoring as S
from recollect.functions import text as T
from recollect.operators import context, dml, forgetting, monitoring, search, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_forget_score(spark):
    got = one(spark, S.forget_score(F.lit(0.5), F.lit(0.3), F.lit(0.2), F.lit(0.7), F.lit(False)))
    assert got == pytest.approx(0.285)


@pytest.mark.parametrize("word, value", [("안녕하세요", 803356551), ("hello", 99162322), ("", 0)])
def test_string_hash(spark, word, value):
    assert one(spark, T.string_hash(F.lit(word))) == value


def test_tokens_and_idf(spark):
    assert one(spark, T.embedding_tokens(F.lit("Hello World! This is a TEST."))) == ["hello", "world", "test"]
    assert one(spark, T.word_idf(F.lit("test123"))) == pytest.approx(1.6)
    assert one(spark, T.word_idf(F.lit("hi"))) == pytest.approx(1.0)


def test_clean_query(spark):
    assert one(spark, T.clean_query(F.lit("  the (hybrid)  search of AND "))) == "hybrid search"
    assert one(spark, T.clean_query(F.lit("기억 이 검색"), stop_words=("이",))) == "기억 검색"


def test_mixed_tokens(spark):
    assert one(spark, T.mixed_tokens(F.lit("안녕 hello world"))) == 2 + 3 + 2


def test_tags_and_summary(spark):
    assert one(spark, T.extracted_tags(F.lit("#a @b c: #a"))) == ["a", "a", "b", "c"]
    long = "One two. " * 40
    assert one(spark, T.summary(F.lit(long))).endswith(".") and len(one(spark, T.summary(F.lit(long)))) <= 230
    assert one(spark, T.summary(F.lit("x" * 300))) == "x" * 200 + "..."


def test_budget_summary(spark):
    text = "First one here. Middle a b c d e f g. Last one."
    assert one(spark, T.budget_summary(F.lit(text), F.lit(100))) == text
    assert one(spark, T.budget_summary(F.lit(text), F.lit(15))) == "First one here  Middle a b c Last one..."
    assert one(spark, T.budget_summary(F.lit("a b c d e f"), F.lit(3))) == "a b..."


def test_format_and_time(spark):
    assert one(spark, T.format_bytes(F.lit(1536.0))) == "1.5 KB"
    assert one(spark, T.format_bytes(F.lit(0.0))) == "0 B"
    assert one(spark, T.relative_time(F.lit(AS_OF - timedelta(hours=5)), AS_OF)) == "5시간 전"


def test_title_hit_and_jaccard(spark):
    assert one(spark, T.title_hit(F.lit("abc"), F.lit("ABC"))) == 1.0
    assert one(spark, T.title_hit(F.lit("abc"), F.lit("abcd"))) == 0.5
    assert one(spark, T.title_hit(F.lit("abc"), F.lit("xabc"))) == 0.2
    assert one(spark, T.word_jaccard(F.lit("a b"), F.lit("b c"))) == pytest.approx(1 / 3)


def test_cleanup_of_three(spark):
    rows = [("soft", 60, 0.1, None, 0, 0), ("hard", 400, 0.1, None, 0, 0), ("recent", 5, 0.9, AS_OF, 5, 1)]
    m = spark.createDataFrame(
        [(i, "episodic", imp, AS_OF - timedelta(days=d), la, False, v, c, 0) for i, d, imp, la, v, c in rows],
        "id string, type string, importance double, created_at timestamp, last_accessed timestamp, pinned boolean, view_count bigint, cite_count bigint, edit_count bigint",
    )
    a = {r["id"]: r for r in forgetting.cleanup(m, AS_OF, 0.6, 0.7).collect()}
    assert {i for i in a if a[i]["soft"]} == {"soft", "hard"} and {i for i in a if a[i]["hard"]} == {"hard"}
    assert a["soft"]["review"] and a["hard"]["review"] and not a["recent"]["review"]
    left = forgetting.apply_cleanup(m, forgetting.cleanup(m, AS_OF, 0.6, 0.7), AS_OF)
    assert {r["id"] for r in left.collect()} == {"recent", "soft"}


def test_hybrid_merge(spark):
    text = spark.createDataFrame([("q", "text", 0.9), ("q", "both", 0.6)], "query_id string, id string, text_score double")
    vector = spark.createDataFrame([("q", "both", 0.8), ("q", "vector", 0.9)], "query_id string, id string, vector_score double")
    w = search.adaptive_weights(spark.createDataFrame([("q", "기억 검색")], "query_id string, query string"))
    got = {r["id"]: r["final_score"] for r in search.combine(text, vector, w).collect()}
    assert got == {"both": 0.74, "vector": 0.63, "text": 0.27}


def test_greedy_fold_skips_what_does_not_fit(spark):
    rows = [("q", "a", "x" * 40, 0.9, 0.9), ("q", "b", "y" * 4000, 0.8, 0.8), ("q", "c", "z" * 8, 0.1, 0.1)]
    hits = spark.createDataFrame(rows, "query_id string, id string, content string, importance double, final_score double")
    assert [(r["id"], r["tokens"]) for r in context.inject(hits, 20, 3).orderBy("position").collect()] == [("a", 10), ("c", 2)]


def test_cooldown(spark):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=s), "m", "warning", 1.0, 0.0, 300) for i, s in enumerate((0, 100, 299, 300, 500, 700))]
    a = spark.createDataFrame(rows, "id bigint, ts timestamp, metric string, level string, value double, threshold double, cooldown int")
    assert sorted(r["id"] for r in monitoring.cooled(a).collect()) == [0, 3, 5]


def test_rolling_alerts_cross_midnight(spark):
    base = datetime(2024, 1, 1, 23, 30)
    e = spark.createDataFrame([(i, "high", base + timedelta(minutes=m)) for i, m in enumerate((0, 20, 40, 120))], "id bigint, severity string, ts timestamp")
    got = monitoring.error_alerts(e, limits={"high": 2}).collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(1, 2), (2, 3)]


def test_violations_are_found(spark):
    m = spark.createDataFrame([("a", "odd", None, 2.0, "secret"), ("a", "working", "x", 0.5, "team")], "id string, type string, content string, importance double, privacy_scope string")
    e = spark.createDataFrame([("b", 3), ("b", 3)], "memory_id string, dim int")
    links = spark.createDataFrame([("a", "z", "likes")], "source_id string, target_id string, relation_type string")
    f = spark.createDataFrame([("z", "liked")], "memory_id string, event string")
    got = {r["rule"]: r["n"] for r in stats.violations(m, e, links, f).collect()}
    assert got == {"type": 1, "content": 1, "importance": 1, "privacy_scope": 1, "duplicate_id": 1, "embedding_memory": 2, "embedding_unique": 1, "relation_type": 1, "link_source": 0, "link_target": 1, "feedback_event": 1, "feedback_memory": 1}


def test_change_tags_keeps_order(spark):
    m = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "id string, tags array<string>")
    got = {r["id"]: r["tags"] for r in dml.change_tags(m, ("z", "x"), ("y",)).collect()}
    assert got == {"a": ["x", "z"], "b": ["z", "x"]}


def test_vector_search_in_parts(spark):
    e = spark.createDataFrame([(f"m{i}", [float(i == j) for j in range(8)]) for i in range(8)], "memory_id string, embedding array<double>")
    q = spark.createDataFrame([(f"q{i}", [float(i == j) for j in range(8)]) for i in range(8)], "query_id string, vector array<double>")
    whole = sorted(map(tuple, search.vector_search(e, q, 3, 0.5).collect()))
    assert whole == sorted(map(tuple, search.vector_search(e, q, 3, 0.5, most_queries=3).collect())) and len(whole) == 8


def test_dense_embedding(spark):
    t = spark.createDataFrame([("a", "hello world hello")], "id string, content string")
    v = search.dense(search.light_embedding(t)).first()["embedding"]
    assert len(v) == 512 and sum(x * x for x in v) == pytest.approx(1) and v[210] > 0
