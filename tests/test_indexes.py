"""Indexes and versions under changes, and operators that have an algorithm of their own, against plain versions."""

import os
import random
import shutil
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect import deploy
from recollect.config import AS_OF, Filters
from recollect.engine import MemoryEngine
from recollect.operators import dml, monitoring, reembed, search, stats
from recollect.operators.index import SearchIndex
from recollect.operators.vectors import VectorIndex
from recollect.plans import queries as Q
from recollect.sources import memory as M
from recollect.storage import Versions, scratch

SF = "/root/testdata/sf0.001"


def _memories(spark, texts):
    rows = [(i, t, "s", ["x"]) for i, t in texts.items()]
    return spark.createDataFrame(rows, "id string, content string, source string, tags array<string>")


def _postings(df):
    return sorted(tuple(r) for r in df.select("id", "term", "tf", "dl").collect())


def test_index_follows_its_memories(spark):
    """Random changes in small batches: after each the index is what a rebuilt one would be, whatever the runs."""
    rng = random.Random(4)
    index, now = SearchIndex(spark, scratch(spark, "index")), {}
    words = [f"w{i}" for i in range(12)]
    for step in range(7):
        new = {f"m{rng.randrange(25)}": " ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(8 if step else 20)}
        gone = [f"m{rng.randrange(25)}" for _ in range(4)]
        gone = [i for i in gone if i not in new]
        index.apply(_memories(spark, new) if step != 3 else None, spark.createDataFrame([(i,) for i in gone] + [("never",)], "id string"))
        now |= new if step != 3 else {}
        now = {i: t for i, t in now.items() if i not in gone}
        plain = search.indexed(_memories(spark, now))
        assert _postings(index.postings()) == _postings(plain)
        assert index.totals()[0] == len(now) and abs(index.totals()[1] - plain.where("head").agg(F.avg("dl")).first()[0]) < 1e-9
    rows = [r["rows"] for r in index.state["runs"]]
    assert all(2 * b < a for a, b in zip(rows, rows[1:], strict=False))
    again = SearchIndex(spark, index.path)
    again.compact()
    assert len(again.state["runs"]) == 1 and _postings(again.postings()) == _postings(plain)
    assert again.state["runs"][0]["dead"] == 0
    again.vacuum()
    assert _postings(SearchIndex(spark, index.path).postings()) == _postings(plain)
    q = spark.createDataFrame([("a", "w1"), ("b", "w2 w3"), ("c", "nothing")], "query_id string, query string")
    hits = lambda i: sorted((r["query_id"], r["id"], round(r["bm25"], 9)) for r in search.bm25(i, q).collect())
    assert hits(again) == hits(plain)
    again.drop()
    assert not SearchIndex(spark, index.path).available()


def test_index_reads_its_terms_only(spark):
    index = SearchIndex(spark, scratch(spark, "index"))
    index.apply(_memories(spark, {f"m{i}": f"common w{i}" for i in range(50)}))
    index.state["buckets"] = 8
    index.compact()
    terms = spark.createDataFrame([("w7",)], "term string")
    plan = index.postings(terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "") or "PartitionFilters" in plan
    assert "EqualTo(term,w7)" in plan or "In(term" in plan
    many = spark.range(2000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    assert index.postings(many).count() == 50 and index.postings(terms).count() == 1


def test_repeated_micro_batch_changes_nothing(spark):
    index = SearchIndex(spark, scratch(spark, "index"))
    for batch, text in ((0, "one"), (1, "two words"), (1, "other"), (0, "older")):
        index.apply(_memories(spark, {"m": text}), batch=batch)
    assert {r["term"] for r in index.postings().collect()} == {"two", "words", "x", "s"}


def test_no_stale_hits(spark, tmp_path):
    """A folder whose documents were replaced is searched by what it has now."""
    folder = str(tmp_path / "sf")
    shutil.copytree(SF, folder)
    one = spark.createDataFrame([("q", "zzfirst zzsecond")], "query_id string, query string")
    path = f"{folder}/documents.parquet"
    old = spark.read.parquet(path).limit(20).toPandas()
    for word in ("zzfirst zzsecond", "zzother"):
        os.remove(path)
        old.assign(text=word, doc_id=old.doc_id + (0 if "first" in word else 500)).to_parquet(path)
        hits = search.bm25(Q.index(spark, folder), one).collect()
        assert len(hits) == (20 if "first" in word else 0)
    Q.release(spark)


def test_keyword_search_with_and_without_an_index(spark):
    m = M.memory_item(spark, SF).cache()
    q = spark.createDataFrame([("a", "sh123x"), ("b", "licence")], "query_id string, query string")
    word = next(w for w in m.select(F.explode(F.split("content", " ")).alias("w")).where("length(w) > 8 and w rlike '^[a-z]+$'").orderBy("w").toPandas().w)
    q = spark.createDataFrame([("a", word)], "query_id string, query string")
    empty = SearchIndex(spark, scratch(spark, "index"))
    full = SearchIndex(spark, scratch(spark, "index"))
    full.apply(m)
    ids = lambda i: {r["id"] for r in search.keyword_search(m, q, i, Filters(types=("semantic", "working"))).collect()}
    scan, by_index = ids(empty), ids(full)
    assert scan == ids(None) and by_index <= scan and (not scan or by_index)
    assert empty.status() == {"available": False, "table_exists": False, "record_count": 0, "version": 0} and full.status()["record_count"] == m.count()


def test_indexes_of_another_source_are_not_used(spark):
    e = M.memory_embedding(spark, SF)
    asked = e.limit(3).select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = VectorIndex(spark, scratch(spark, "vectors"))
    hits = lambda *a, **k: {(r["query_id"], r["memory_id"]) for r in search.vector_recall(e, asked, *a, limit=5, threshold=0.0, **k).collect()}
    exact = hits()
    assert hits(index) == exact
    index.rebuild(e.limit(40), source="one")
    assert hits(index, source="two") == exact != hits(index, source="one", probes=100)
    words = SearchIndex(spark, scratch(spark, "index"))
    words.apply(_memories(spark, {"m1": "word"}), source="one")
    m = _memories(spark, {"m1": "word", "m2": "words"})
    q = spark.createDataFrame([("q", "word")], "query_id string, query string")
    assert {r["id"] for r in search.keyword_search(m, q, words, source="one").collect()} == {"m1"}
    assert {r["id"] for r in search.keyword_search(m, q, words, source="two").collect()} == {"m1", "m2"}


def test_versions_refuse_a_second_writer(spark):
    path = scratch(spark, "versions")
    a, b = Versions(spark, path), Versions(spark, path)
    assert a.current() is None and b.current() is None
    a.commit({"x": 1})
    with pytest.raises(RuntimeError):
        b.commit({"x": 2})
    assert b.current() == {"x": 1} and b.commit({"x": 3}) == 2 and a.read(1) == {"x": 1}


def test_vector_index_recall(spark):
    """0.9 at least of the ten best at three quarters of the cells; the exact way finds all."""
    index, asked = Q.vector_index(spark, "/root/testdata/sf0.01"), Q.many_vectors(spark, "/root/testdata/sf0.01")
    exact = {(r["query_id"], r["memory_id"]) for r in search.vector_search(Q.embedded(spark, "/root/testdata/sf0.01"), asked, 10, 0.0).collect()}
    near = {(r["query_id"], r["memory_id"]) for r in index.search(asked, 10, 0.0, round(0.75 * len(index.state["cells"]))).collect()}
    assert len(near & exact) >= 0.9 * len(exact) > 100
    assert {(r["query_id"], r["memory_id"]) for r in index.search_exactly(asked, 10, 0.0, 1).collect()} == exact


def test_vector_index_prunes_in_clusters(spark):
    """Where vectors come in clusters, few cells are enough for all."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24)) * 5
    rows = [(f"m{i}", (centres[i % 20] + rng.standard_normal(24) * 0.1).tolist()) for i in range(800)] + [("none", None), ("zero", [0.0] * 24), ("short", [1.0])]
    e = spark.createDataFrame(rows, "memory_id string, embedding array<double>")
    index = VectorIndex(spark, scratch(spark, "vectors"))
    assert not index.status()["available"] and index.search(e.limit(0).toDF("query_id", "vector"), 5).count() == 0
    index.rebuild(e, cells=20)
    q = e.where("memory_id in ('m3', 'm44', 'm111')").toDF("query_id", "vector")
    hits = lambda df: {(r["query_id"], r["memory_id"], r["rank"]) for r in df.collect()}
    plain = hits(search.vector_search(e, q, 7, 0.5))
    assert hits(index.search(q, 7, 0.5, probes=3)) == plain == hits(index.search_exactly(q, 7, 0.5, probes=1))
    assert index.status() == {"available": True, "table_exists": True, "record_count": 800, "dimensions": 24}
    index.rebuild(e.limit(0))
    assert not index.status()["available"]


def test_embeddings_are_swapped_only_when_verified(spark):
    m = M.memory_item(spark, SF).limit(20).cache()
    table = reembed.EmbeddingTable(spark, scratch(spark, "table"))

    def made(size, broken=0):
        at = F.row_number().over(search.Window.orderBy("id"))
        v = F.when(at <= broken, F.array_repeat(F.lit(float("nan")), size)).otherwise(F.array_repeat(F.lit(1.0), size))
        return m.select(F.col("id").alias("memory_id"), v.alias("embedding"), F.lit(size).alias("dim"), F.lit("x").alias("model"), F.lit(AS_OF).alias("created_at"))

    assert table.current().count() == 0
    assert [tuple(r) for r in table.replace(made(4), m, 4).collect()] == [(4, 20, 0)]
    with pytest.raises(ValueError, match="3 of 20"):
        table.replace(made(8, 3), m, 8)
    assert {r["dim"] for r in table.current().collect()} == {4}
    table.replace(made(8, 3), m, 8, most_failed=0.2)
    again = reembed.EmbeddingTable(spark, table.path)
    assert {r["dim"] for r in again.current().collect()} == {8} and {r["dim"] for r in again.backup().collect()} == {4}
    odd = made(8).unionByName(made(8).limit(2)).unionByName(made(8).limit(1).withColumn("memory_id", F.lit("unknown")))
    assert {tuple(r) for r in reembed.verified(odd.where(f"memory_id <> '{m.orderBy(F.desc('id')).first()['id']}'"), m, 8).collect()} >= {(None, 1, 0)}


def test_split_batch(spark):
    m = M.memory_item(spark, SF)
    rows = m.limit(4).collect()
    new = [tuple(r) for r in rows]
    ids = ["new_1", "new_2", "new_2", rows[3]["id"]]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in zip(ids, new, strict=True)], m.schema)
    taken, refused, seen = dml.split_batch(df, m)
    assert sorted(r["id"] for r in taken.collect()) == ["new_1", "new_2"]
    assert seen.get == {"accepted": 2, "refused": 2}
    assert sorted((r["id"], r["errors"]) for r in refused.collect()) == sorted([("new_2", "repeated"), (rows[3]["id"], "exists")])


@pytest.mark.parametrize("seed", range(2))
def test_order_statistics(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("a", float(x)) for x in rng.normal(0, 1e6, 500)] + [("b", float(x)) for x in rng.integers(0, 3, 400)] + [("c", 5.0)] + [("d", float(x)) for x in np.r_[np.zeros(99), 1e12]] + [("a", None)]
    got = {(r["g"], r["share"]): r["value"] for r in stats.order_statistics(spark.createDataFrame(rows, "g string, x double"), "x", (0.0, 0.5, 0.95, 1.0), ("g",), bins=8).collect()}
    for g in "abcd":
        own = sorted(x for k, x in rows if k == g and x is not None)
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[g, p] == own[min(len(own) - 1, int(np.floor(len(own) * p)))]
    assert stats.latency_stats(spark.createDataFrame([], "time_ms double")).count() <= 1


def _alerts(spark, rows):
    base = datetime(2024, 1, 1, 23, 30)
    full = [(i, base + timedelta(seconds=s), m, "warning", 1.0, 0.0, 300) for i, (m, s) in enumerate(rows)]
    return spark.createDataFrame(full, "id bigint, ts timestamp, metric string, level string, value double, threshold double, cooldown int").repartition(5)


def test_cooldown_in_runs(spark):
    """Dense runs over midnight, gaps, equal times: as one pass in order."""
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice((rng.randrange(0, 9000), 40 * rng.randrange(100), 200_000 + rng.randrange(3000)))) for _ in range(400)]
    plain, last = set(), {}
    for s, i, m in sorted((s, i, m) for i, (m, s) in enumerate(rows)):
        if m not in last or s - last[m] >= 300:
            last[m] = s
            plain.add(i)
    assert {r["id"] for r in monitoring.cooled(_alerts(spark, rows)).collect()} == plain


def test_until_resolved(spark):
    rng = random.Random(2)
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(hours=rng.randrange(200)), rng.choice("ab"), rng.random() < 0.2) for i in range(300)]
    plain, active = set(), {}
    for _, ts, _, i, m, resolve in sorted((m, ts, not r, i, m, r) for i, ts, m, r in rows):
        if resolve:
            active[m] = False
        elif not active.get(m):
            active[m] = True
            plain.add(i)
    got = monitoring.until_resolved(spark.createDataFrame(rows, "id bigint, ts timestamp, metric string, resolve boolean"))
    assert {r["id"] for r in got.collect()} == plain


def test_index_advice(spark):
    log = [("SELECT a FROM t WHERE x = 1 AND y > 2 ORDER BY z DESC, x LIMIT 3", 300.0)] * 12 + [("SELECT a FROM t WHERE x < 3", 1.0)] * 60 + [("SELECT 1", 9.0)] * 99 + [("select a from u where k = 1 or k = 2", 5.0)] * 11
    got = {(r["table"], r["columns"], r["kind"]): (r["n"], r["priority"]) for r in monitoring.index_advice(spark.createDataFrame(log, "query string, time_ms double")).collect()}
    assert got == {("t", "x", "single"): (72, "high"), ("t", "y", "single"): (12, "medium"), ("t", "x,y", "pair"): (12, "medium"), ("t", "x,y,z", "combined"): (12, "high"), ("u", "k", "single"): (11, "medium")}


def test_engine_keeps_embeddings_with_its_memories(spark):
    m = M.memory_item(spark, SF)
    e = MemoryEngine(spark, m, M.memory_embedding(spark, SF).limit(0), as_of=AS_OF)
    new = e.remember(spark.createDataFrame([("mem_new", "a quite remarkable new thing"), ("mem_blank", "the")], "id string, content string"))
    made = {r["memory_id"]: r for r in new.embeddings.collect()}
    assert set(made) == {"mem_new"} and made["mem_new"]["dim"] == len(made["mem_new"]["embedding"]) == 512
    one = spark.createDataFrame([("q", "remarkable thing")], "query_id string, query string")
    assert "remarkable new thing" in new.inject(one).first()["prompt"]


def test_compressed(spark):
    hits = spark.createDataFrame([("q", f"m{i}", i + 1, (i * 7 % 10) / 10) for i in range(10)], "query_id string, id string, rank int, score double")
    got = search.compressed(hits, 3, 0.7).collect()
    assert [(r["id"], r["rank"], r["original_count"]) for r in sorted(got, key=lambda r: r["rank"])] == [("m2", 2, 5)][:0] + sorted([(r["id"], r["rank"], 5) for r in got], key=lambda x: x[1])
    assert sorted((r["score"] for r in got), reverse=True) == sorted(((i * 7 % 10) / 10 for i in range(5)), reverse=True)[:3]


def test_filters_echo_and_project(spark):
    f = Filters(types=("semantic",), project="p1")
    assert f.applied() == {"types": ("semantic",), "project": "p1"} and Filters().applied() == {}
    m = M.memory_item(spark, SF).withColumn("project_id", F.when(F.col("pinned"), "p1").otherwise("p2"))
    assert search.apply_filters(m, f).count() == m.where("type = 'semantic' and pinned").count()


def test_every_cluster_gets_the_package(monkeypatch):
    """Only a local master's workers share the driver's folder."""

    class Context:
        applicationId = "app-1"

        def __init__(self, master):
            self.master, self.shipped = master, []

        def addPyFile(self, path):
            self.shipped.append(path)

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    monkeypatch.chdir(deploy.ROOT)
    for master, n in (("local[8]", 0), ("spark://host:7077", 1), ("yarn", 1), ("local-cluster[2,1,1024]", 1)):
        monkeypatch.setattr(deploy, "_shipped", set())
        s = Session(master)
        deploy.ship(s)
        deploy.ship(s)
        assert len(s.sparkContext.shipped) == n
