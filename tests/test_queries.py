"""Every registered query against its SQL twin, and the facade."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recollect.config import AS_OF, Filters
from recollect.engine import MemoryEngine
from recollect.operators import stats
from recollect.plans import queries as Q
from recollect.sources import memory as M

SF = "/root/testdata/sf0.001"
SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(against_sql, name):
    against_sql(Q.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(SQL)))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 11))


def test_registered_together(spark):
    assert set(SQL) <= set(entry.oracle_sql()) and set(Q.queries()) <= set(entry.queries())


def test_row_order_does_not_matter(spark):
    q = M.queries_table(spark)
    m = M.memory_item(spark, SF)
    from recollect.operators.search import text_search

    a = text_search(m, q, AS_OF).select("query_id", "rank", "id").collect()
    b = text_search(m.orderBy(F.rand(3)).repartition(5), q, AS_OF).select("query_id", "rank", "id").collect()
    assert sorted(a) == sorted(b)


def test_engine(spark):
    m = M.memory_item(spark, SF).cache()
    e = MemoryEngine(spark, m, as_of=AS_OF)
    free = m.where("not pinned").orderBy("id").first()["id"]
    pinned, status = e.pin(free, "nothing")
    assert dict(map(tuple, status.collect())) == {free: "pinned", "nothing": "not_found"}
    assert pinned.memories.where(F.col("id") == free).first()["pinned"]
    refused, status = pinned.forget(free, hard=True, confirm=True)
    assert status.first()["status"] == "pinned" and refused.memories.count() == m.count()
    gone, _ = e.forget(free, hard=True, confirm=True)
    assert gone.memories.count() == m.count() - 1
    new = e.remember(spark.createDataFrame([("mem_new", "a new thing")], "id string, content string"))
    row = new.memories.where("id = 'mem_new'").first()
    assert (row["type"], row["importance"], row["privacy_scope"], row["view_count"]) == ("episodic", 0.5, "private", 0)
    one = spark.createDataFrame([("q", "new thing")], "query_id string, query string")
    assert new.recall(one, limit=3).orderBy("rank").first()["id"] == "mem_new"
    assert "new thing" in new.inject(one).first()["prompt"]
    with pytest.raises(ValueError):
        e.recall(one, Filters(importance_min=0.9, importance_max=0.1))
    after, actions = e.cleanup(dry_run=False, hard=0.62)
    assert after.memories.count() == m.count() - actions.where("hard").count()


def test_validate_memories_without_text(spark, tmp_path):
    """Its SQL over documents of which some have an empty text or none; all fields name the content too."""
    n, folder = F.col("doc_id"), str(tmp_path)
    d = M.table(spark, SF, "documents").withColumn("text", F.when(n % 5 == 0, "").when(n % 7 == 0, None).when(n % 11 == 0, "  ").otherwise(F.col("text")))
    d.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    M.table(spark, SF, "events").write.parquet(f"{folder}/events.parquet")
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
    got = Q.queries()["validate_memories"](spark, folder).select("id", "errors").collect()
    expected = con.execute(f"SELECT id, errors FROM ({SQL['validate_memories']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(expected) and expected
    m = M.memory_item(spark, folder).withColumn("importance", F.col("importance") * 1.5)
    every = dict(map(tuple, stats.invalid_memories(m).collect()))
    for i in (int(r["doc_id"]) for r in d.select("doc_id").collect()):
        wrong = [x for x, bad in (("content", i % 5 == 0 or i % 7 == 0), ("importance", i * 7 % 11 * 0.15 > 1)) if bad]
        assert every.get(f"mem_{i}", "") == ",".join(wrong)


@pytest.mark.parametrize("name", ["vector_topk_many", "vector_topk_by_type_many", "vector_l2_similarity_many"])
def test_searches_by_every_twentieth_vector(spark, name):
    kinds = {r["id"]: r["type"] for r in M.memory_item(spark, SF).select("id", "type").collect()}
    every = {r["memory_id"]: np.array(r["embedding"]) for r in M.memory_embedding(spark, SF).collect()}
    plain = {}
    for q in (m for m in every if int(m[4:]) % 20 == 0):
        hits = []
        for m in every:
            if m in kinds and ("type" not in name or kinds[m] == "semantic"):
                a, b = every[q], every[m]
                near = max(0.0, 1 - np.linalg.norm(a - b)) if "l2" in name else a @ b / np.sqrt((a @ a) * (b @ b))
                hits += [(-round(near, 6), m)] if "l2" in name or round(near, 6) >= 0.15 else []
        plain |= {(q, k + 1): h for k, h in enumerate(sorted(hits)[: 5 if "l2" in name else 10])}
    got = {(r["query_id"], r["rank"]): (-r["similarity"], r["memory_id"]) for r in Q.queries()[name](spark, SF).collect()}
    assert got.keys() == plain.keys() and len({q for q, _ in got}) > 3
    assert all(abs(got[k][0] - plain[k][0]) < 2e-6 for k in got)
    assert sum(got[k][1] != plain[k][1] for k in got) <= len(got) // 100


def test_link_dedup_adds_every_link(spark, monkeypatch):
    added = []
    plain = Q.dml.add_links
    monkeypatch.setattr(Q.dml, "add_links", lambda links, new: added.append(new.count()) or plain(links, new))
    Q.queries()["link_dedup"](spark, SF).collect()
    assert added == [M.memory_link(spark, SF).count()] and added[0] > 10
