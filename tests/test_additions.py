"""Closed-form cases of settings, presets, exports, sinks, migration and searches that have no SQL twin of their own."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.config import AS_OF, PRESETS, STOP_WORDS, Filters, Settings, search_errors
from recollect.engine import MemoryEngine
from recollect.functions import text as T
from recollect.operators import context, dml, monitoring, search, stats
from recollect.sources import memory as M

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names)).alias("x")).first()["x"]


def test_settings():
    assert Settings().errors() == [] and Settings().ttl_hours() == {"working": 48, "episodic": 2160, "semantic": None, "procedural": None}
    s = Settings.from_env({"EMBEDDING_PROVIDER": "other", "PORT": "80", "LOG_LEVEL": "", "FORGET_SEMANTIC_TTL": "5"})
    assert (s.port, s.log_level, s.ttl_hours()["semantic"]) == (80, "info", 5) and s.errors() == ["embedding_api_key is required for other"]
    assert Settings().model_info() == {"model": "lightweight-hybrid", "dimensions": 512, "max_tokens": 8191, "available": True} and not s.model_info()["available"]
    assert search_errors("x", 5, {"type": ["a"]}) == [] and search_errors("", -1, {"type": "a", "tags": ("b",)}) == ["query is not a text", "limit is not a number from 0", "filters.type is not a list"]
    assert Settings.from_env({"SEARCH_MAX_LIMIT": "5", "OTHER": "x"}).errors() == ["search_default_limit is above search_max_limit"]
    assert len(Settings(embedding_dimensions=0, search_max_limit=0).errors()) == 2


def test_korean_stop_words(spark):
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 318 and {"the", "이", "때문에", "개별적으로", "오이고", "모든 것을"} <= set(STOP_WORDS)
    assert one(spark, T.clean_query, "프로젝트 의 진행 상황에서 the 결과") == "프로젝트 진행"


def test_string_hash_of_other_scripts(spark):
    for word in ("abc", "기억", "\U0001f600x", "a" * 40):
        units = np.frombuffer(word.encode("utf-16-le"), np.uint16).tolist()
        h = 0
        for u in units:
            h = (h * 31 + u + 2**31) % 2**32 - 2**31
        assert one(spark, T.string_hash, word) == h


def test_migrated_has_every_column(spark):
    old = spark.createDataFrame([("mem_1", "text", None)], "id string, content string, view_count bigint")
    row = M.migrated(old).first()
    assert (row["id"], row["view_count"], row["cite_count"], row["type"]) == ("mem_1", 0, 0, None)


def test_latest_state(spark):
    rows = [(1, datetime(2024, 1, 1), 1, "raised"), (1, datetime(2024, 1, 2), 2, "acknowledged"), (1, datetime(2024, 1, 2), 3, "resolved"), (2, datetime(2024, 1, 1), 1, "raised")]
    got = monitoring.latest_state(spark.createDataFrame(rows, "id bigint, ts timestamp, seq bigint, state string")).collect()
    assert {r["id"]: r["state"] for r in got} == {1: "resolved", 2: "raised"}


def test_exports(spark):
    m = M.memory_item(spark, SF)
    e = MemoryEngine(spark, m, as_of=AS_OF)
    n = m.where("type = 'semantic'").count()
    for kind in ("csv", "json", "markdown"):
        assert e.export(kind, Filters(types=("semantic",))).count() == n
    line = e.export("json").where("id = 'mem_3'").first()["json"]
    back = spark.createDataFrame([(line,)], "json string").select(F.from_json("json", M.MEMORY).alias("m")).first()["m"]
    assert back["id"] == "mem_3" and back["content"] == m.where("id = 'mem_3'").first()["content"]


def test_written_out_engine(spark, tmp_path):
    e = MemoryEngine(spark, M.memory_item(spark, SF), M.memory_embedding(spark, SF), as_of=AS_OF)
    pinned, _ = e.pin("mem_3", "mem_5")
    again = pinned.written_out(str(tmp_path / "v1"))
    assert again.memories.where("pinned").count() == pinned.memories.where("pinned").count()
    assert "FileScan" in again.memories._jdf.queryExecution().executedPlan().toString()
    assert again.memories.columns == e.memories.columns and again.embeddings.count() == e.embeddings.count()


def test_json_lines_by_day(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 5), "a"), (2, datetime(2024, 1, 1, 9), "b"), (3, datetime(2024, 1, 2), "c")]
    path = str(tmp_path / "alerts")
    for part in (rows[:1], rows[1:]):
        monitoring.write_json_by_day(spark.createDataFrame(part, "id bigint, ts timestamp, message string"), path)
    got = spark.read.json(path).groupBy("date").count().collect()
    assert {str(r["date"]): r["count"] for r in got} == {"2024-01-01": 2, "2024-01-02": 1}


def test_missing_tables(spark):
    spark.range(1).createOrReplaceTempView("memory_item_seen")
    assert stats.missing_tables(spark, ("memory_item_seen", "never_made")) == ["never_made"]


def test_find_similar_without_itself(spark):
    m, e = M.memory_item(spark, SF), M.memory_embedding(spark, SF)
    ids = m.where("id in ('mem_3', 'mem_20')").select("id")
    kinds = {r["id"]: r["type"] for r in m.select("id", "type").collect()}
    with_self = search.find_similar(m, e, ids, 4, 0.0).collect()
    assert {(r["id"], r["similar_id"]) for r in with_self if r["rank"] == 1} == {("mem_3", "mem_3"), ("mem_20", "mem_20")}
    without = search.find_similar(m, e, ids, 4, 0.0, exclude_self=True).collect()
    assert all(r["id"] != r["similar_id"] and kinds[r["id"]] == kinds[r["similar_id"]] for r in without)
    assert len(without) == 8 and {r["rank"] for r in without} == {1, 2, 3, 4}


def test_vectors_of_several_sizes(spark):
    """Each query meets the vectors of its own size only; more queries than one broadcast holds are cut by hash."""
    rng = np.random.default_rng(1)
    rows = [(f"m{i}", rng.normal(size=(4, 7)[i % 2]).tolist()) for i in range(60)] + [("null", None), ("zero", [0.0] * 4)]
    e = spark.createDataFrame(rows, "memory_id string, embedding array<double>").repartition(3)
    asked = [(f"q{i}", rng.normal(size=(4, 7, 9)[i % 3]).tolist()) for i in range(9)] + [("none", None)]
    q = spark.createDataFrame(asked, "query_id string, vector array<double>")
    plain = set()
    for name, v in asked:
        if v is None:
            continue
        hits = []
        for m, x in rows:
            if x is not None and len(x) == len(v):
                n = np.linalg.norm(x) * np.linalg.norm(v)
                hits.append((-round(float(np.dot(x, v) / n), 6) if n else 0.0, m))
        plain |= {(name, m, k + 1) for k, (s, m) in enumerate(sorted(hits)[:5]) if -s >= 0.1}
    for most in (4096, 4):
        got = search.vector_search(e, q, 5, 0.1, most_queries=most).collect()
        assert {(r["query_id"], r["memory_id"], r["rank"]) for r in got} == plain


def test_ids_make_the_query_text_irrelevant(spark):
    m = M.memory_item(spark, SF)
    q = spark.createDataFrame([("a", "zzz qqq"), ("b", "")], "query_id string, query string")
    got = search.text_search(m, q, AS_OF, Filters(ids=("mem_3", "mem_4")), 5).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(x, i) for x in "ab" for i in ("mem_3", "mem_4")}


@pytest.mark.parametrize("preset", sorted(PRESETS))
def test_presets(spark, preset):
    m = M.memory_item(spark, SF)
    q = spark.createDataFrame([("a", "tion"), ("b", "nothing has these words")], "query_id string, query string")
    got = {r["query_id"]: r for r in MemoryEngine(spark, m, as_of=AS_OF).inject_preset(q, preset).collect()}
    kind = PRESETS[preset].kind
    assert got["b"]["memories_used"] == 0 and got["b"]["content"] == context.NOTHING[kind] + '\n\n💡 "nothing has these words"에 대해 새로운 정보로 답변해주세요.'
    if got["a"]["memories_used"]:
        assert got["a"]["content"].startswith(context.HEADERS[kind] + "\n\n1. ") and "(관련도: " in got["a"]["content"]
    assert preset != "project" or got["a"]["memories_used"] > 0


def test_working_memory_that_expires(spark):
    rows = [(1, [(1, "user", "hello"), (2, "assistant", None)], AS_OF - timedelta(hours=1)), (2, [(1, "user", "later")], AS_OF + timedelta(hours=1))]
    b = spark.createDataFrame(rows, "session_id bigint, items array<struct<turn:bigint,role:string,text:string>>, expires_at timestamp")
    got = dml.buffer_snapshots(b, AS_OF).collect()
    assert [(r["id"], r["type"], r["content"]) for r in got] == [("mem_wm_1", "episodic", "user: hello\nassistant: ")]
    m = M.memory_item(spark, SF)
    assert dml.remember(m, dml.buffer_snapshots(b, AS_OF), AS_OF).count() == m.count() + 1


def test_package_reaches_workers_from_another_folder(tmp_path):
    """A session in another working directory, whose workers do not find the package by themselves."""
    code = f"""
import sys, tempfile
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["vector_topk"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
