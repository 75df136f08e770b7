"""What keeps a task's memory and a query's work in proportion: plans and pieces, on small tables."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import index as I
from recollect.operators import search
from recollect.operators import vectors as V
from recollect.sources import memory as M
from recollect.storage import settings

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [search.postings, lambda m: search.doc_lengths(search.indexed(m)), lambda m: search.light_embedding(m.select("id", "content")), lambda m: search.light_vectors(m.select("id", "content"))])
def test_words_are_summed_within_rows(spark, make):
    m = spark.createDataFrame([("a", "x y x", ["t"], "s")], "id string, content string, tags array<string>, source string")
    assert not any(x in plan(make(m)) for x in ("Aggregate", "Window", "Sort "))


def test_counted(spark):
    rows = [(["b", "a", "b", "", "b"],), ([],), (None,), (["z"],)]
    got = spark.createDataFrame(rows, "w array<string>").select("w", T.counted(F.col("w")).alias("n")).collect()
    assert [r["n"] and [tuple(x) for x in r["n"]] for r in got] == [[("", 1), ("a", 1), ("b", 3)], [], None, [("z", 1)]]


def test_light_vectors_are_the_dense_cells(spark):
    m = M.memory_item(spark, SF).select("id", "content").limit(30)
    rows = spark.createDataFrame([*m.collect(), ("none", None), ("blank", " ")], m.schema)
    a, b = ({r["id"]: r["embedding"] for r in x.collect()} for x in (search.light_vectors(rows), search.dense(search.light_embedding(rows))))
    assert a.keys() == b.keys() and "blank" not in a
    assert all(np.allclose(a[k], b[k]) and abs(np.linalg.norm(a[k]) - 1) < 1e-9 for k in a)


def test_task_words_are_as_column_words(spark):
    """What a task makes of lower-case texts is what the column expressions say of each word."""
    words = ["api", "snake_case", "x9", "2024", "한국어", "가나", "_x", "javascripts", "longerword", "polynomials", "e\u0301t", "zz" * 40, "ab" * 2000]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    told = {r["w"]: r for r in rows.select("w", T.bucket(F.col("w")).alias("b"), T.word_idf(F.col("w")).alias("idf"), F.log(T.keyword_factor(F.col("w"), F.lit(1))).alias("f")).collect()}
    plain = [w for w in words if "\u0301" not in w]
    for w, b, idf, f in zip(plain, *T.word_facts(pa.array(plain)), strict=True):
        assert (b, pytest.approx(idf), pytest.approx(f)) == (told[w]["b"], told[w]["idf"], told[w]["f"])
    texts = ["The API, api api API; snake_case e\u0301t\u00a0x9 2024!", "", None, "the of and", "한국어 가나\x0bzz\U0001f600zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    tokens = {r["id"]: set(r["t"] or ()) for r in df.select("id", T.embedding_tokens(F.col("content")).alias("t")).collect()}
    buckets = {i: {told_b for told_b in T.word_facts(pa.array(sorted(t)))[0].tolist()} if t else set() for i, t in tokens.items()}
    got: dict = {i: set() for i in tokens}
    for r in search.light_embedding(df).collect():
        got[int(r["id"])].add(r["bucket"])
    assert got == buckets


def test_a_vector_is_made_once_and_not_for_each_place(spark):
    """Neither the cells nor a map of them is made again for each of a vector's 512 numbers, and no regex of Spark's runs in a loop."""
    m = spark.createDataFrame([("a", "x y x")], "id string, content string")
    for df in (search.light_vectors(m), search.dense(search.light_embedding(m))):
        shown = df._jdf.queryExecution().optimizedPlan().toString()
        assert "coalesce(map_from_entries" not in shown and "rlike" not in shown.lower()


def test_an_index_counts_each_text_once(spark, tmp_path, monkeypatch):
    count, real = spark.sparkContext.accumulator(0), search.indexed

    def rows(batches):
        for b in batches:
            count.add(len(b))
            yield b

    monkeypatch.setattr(I, "indexed", lambda m: (lambda out: out.mapInArrow(rows, out.schema))(real(m)))
    m = M.memory_item(spark, SF).limit(20).cache()
    i = I.SearchIndex(spark, str(tmp_path / "index"))
    i.apply(m)
    assert count.value == real(m).count() and i.totals()[0] == 20 == i.docs().count()
    m.unpersist()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The index over sf0.001 in eight buckets."""
    m = M.memory_item(spark, SF)
    with pytest.MonkeyPatch.context() as p:
        p.setattr(I, "BUCKET_ROWS", 20_000)
        i = I.SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
        i.apply(m)
    return m, i


def test_postings_are_dealt_before_they_multiply(spark, made, monkeypatch):
    """Of a stored index, what is grouped by query and memory lies in pieces by id: no shuffle has a row for each query and memory."""
    m, i = made
    monkeypatch.setattr(I, "BUCKET_ROWS", 5_000)
    assert i.pieces() == sum(r["rows"] for r in i.state["runs"]) // 5_000 + 1 > 2
    asked = M.asked(spark, SF)
    scores = search.bm25(i, asked)
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", plan(scores))
    got, want = ({(r["query_id"], r["id"]): r["bm25"] for r in search.bm25(x, asked).collect()} for x in (i, search.indexed(m)))
    assert len(got) > 100 and got == pytest.approx(want, abs=1e-9)
    hits = search.fts_match(i, asked, m)
    assert not re.search(r"hashpartitioning\(query_id#\d+, id#", plan(hits))
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, search.fts_match(search.indexed(m), asked, m).collect()))


def test_many_query_terms_are_not_sent_to_every_task(spark, made, monkeypatch):
    m, i = made
    monkeypatch.setattr(search, "MOST_PAIRS", 3)
    asked = M.queries_table(spark)
    got = search.bm25(i, asked)
    assert got.count() == search.bm25(search.indexed(m), asked).count() > 0


def test_a_write_sorts_parts(spark, tmp_path, monkeypatch):
    """A task of an index's write takes PART_BYTES of a bucket and not whatever the session's tasks take, unless that is less."""
    files = []
    for k, size in enumerate((1 << 30, 20_000)):
        monkeypatch.setattr(I, "PART_BYTES", size, raising=False)
        i = I.SearchIndex(spark, str(tmp_path / str(k)))
        with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):  # so small a table is one task otherwise
            i.apply(M.memory_item(spark, SF))
        run = f"{i.path}/runs/{i.state['runs'][0]['name']}/postings"
        files.append(len(spark.read.parquet(run).inputFiles()))
    assert files[0] < files[1]
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") not in ("20000", str(1 << 30))


def test_budget_summary_splits_once(spark):
    df = spark.createDataFrame([("One two. Three four! Five six? Seven",)], "t string")
    shown = plan(df.select(T.budget_summary(df.t, F.lit(6)).alias("s")))
    assert shown.count("[.!?]+") <= shown.count("Project") == 1


def test_vector_tiles_are_bounded(monkeypatch):
    """No more similarities at a time than a tile has, and hits below an earlier block's limit-th are left out."""
    rng, seen, real = np.random.default_rng(1), [], V.similarities
    q, e = rng.normal(size=(300, 8)), rng.normal(size=(900, 8))
    monkeypatch.setattr(V, "TILE", 5000, raising=False)
    monkeypatch.setattr(V, "similarities", lambda a, b, s: seen.append(len(a) * len(b)) or real(a, b, s))
    names, ids = [f"q{i}" for i in range(300)], [f"m{i}" for i in range(900)]
    rows = [(0, 8, names, q.tobytes(), ids[i : i + 100], e[i : i + 100].tobytes()) for i in range(0, 900, 100)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("q_block", "size", "q_ids", "q_data", "ids", "data"), r, strict=True)) for r in rows])
    out = [(r["query_id"], r["memory_id"], r["similarity"]) for b in V._nearest(5, 0.0, "cosine")(iter([batch])) for r in b.to_pylist()]
    s = real(q, e, "cosine")
    for i in range(300):
        mine = sorted((x[2] for x in out if x[0] == f"q{i}"), reverse=True)[:5]
        assert mine == sorted(s[i][s[i] >= 0], reverse=True)[:5]
    assert max(seen) <= 5000 and len(out) < 300 * 5 * 9 * 3 // 4


def test_ties_of_a_block_are_cut_by_id():
    """Vectors that are all as far from a query go on as the limit smallest ids of a block and not all."""
    q, e = np.zeros((2, 4)), np.full((50, 4), 3.0)
    e[7] = 0.1
    ids = [f"m{i}" for i in range(50)]
    batch = pa.RecordBatch.from_pylist([{"q_block": 0, "size": 4, "q_ids": ["a", "b"], "q_data": q.tobytes(), "ids": ids, "data": e.tobytes()}])
    out = [(r["query_id"], r["memory_id"]) for b in V._nearest(3, -1.0, "one_minus_l2")(iter([batch])) for r in b.to_pylist()]
    assert sorted(out) == [(x, m) for x in "ab" for m in ("m0", "m1", "m7")]
