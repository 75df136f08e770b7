"""Streams run to their end over files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollect.config import AS_OF
from recollect.operators import dml, monitoring
from recollect.operators.index import SearchIndex
from recollect.operators.search import postings
from recollect.plans import queries as Q
from recollect.sources import memory as M
from recollect.streaming import pipelines, state

SF = "/root/testdata/sf0.001"


def _stream(spark, df, path, files=1):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_ingest(spark, tmp_path):
    m = M.memory_item(spark, SF).limit(20)
    q = pipelines.ingest(_stream(spark, m, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/items")).count() == 20
    assert spark.read.parquet(str(tmp_path / "out/embeddings")).select("id").distinct().count() == 20


def test_hourly_errors(spark, tmp_path):
    e = M.error_log(spark, SF).select("ts", "severity")
    late = e.agg(F.max("ts")).first()[0] + timedelta(days=2)
    e = e.union(spark.createDataFrame([(late, "low")], "ts timestamp, severity string"))
    got = _run(spark, pipelines.hourly_errors(_stream(spark, e, str(tmp_path / "in"))), "hourly")
    expected = M.error_log(spark, SF).groupBy("severity", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_cooldown_like_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=70 * i), "m", ("warning", "critical")[i % 3 == 0], 1.0, 0.0, 300) for i in range(40)]
    a = spark.createDataFrame(rows, "id bigint, ts timestamp, metric string, level string, value double, threshold double, cooldown int")
    got = _run(spark, pipelines.cooldown(_stream(spark, a, str(tmp_path / "in"))), "cooled")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in monitoring.cooled(a).collect())


def test_sessions(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(1, base, "abcd"), (1, base + timedelta(hours=5), "abcdefgh"), (1, base + timedelta(days=9), "x"), (2, base + timedelta(days=40), "end")]
    t = spark.createDataFrame(rows, "session_id bigint, ts timestamp, text string")
    got = _run(spark, pipelines.working_sessions(_stream(spark, t, str(tmp_path / "in"))), "sessions")
    assert sorted((r["session_id"], r["turns"], r["tokens"]) for r in got.collect()) == [(1, 1, 1), (1, 2, 3)]


def _in_parts(spark, df, path, parts, end, **last):
    """A stream of df's rows in order of time, in so many micro-batches, and a last row that takes the watermark past all."""
    pdf = df.orderBy("ts", *[c for c in ("id", "turn") if c in df.columns]).toPandas()
    n = len(pdf)
    for k in range(parts):
        part = spark.createDataFrame(pdf.iloc[n * k // parts : n * (k + 1) // parts].sample(frac=1, random_state=k), df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    row = {c: None for c in df.columns} | {"ts": end} | last
    spark.createDataFrame([tuple(row[c] for c in df.columns)], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


END = datetime(2025, 1, 1)


def test_error_alerts_in_a_stream(spark, tmp_path):
    state.rocksdb(spark)
    e = M.error_log(spark, SF).select("id", "ts", "severity")
    limits = {"low": 2, "medium": 2, "high": 2, "critical": 1}
    got = _run(spark, state.error_alerts(_in_parts(spark, e, str(tmp_path / "in"), 5, END, id=-1, severity="low"), limits, "0 seconds"), "alerts")
    plain = monitoring.error_alerts(M.error_log(spark, SF), limits=limits)
    assert sorted(map(tuple, got.where("id >= 0").collect())) == sorted(map(tuple, plain.select("id", "severity", "n").collect()))


def test_cooldown_state(spark, tmp_path):
    state.rocksdb(spark)
    a = monitoring.triggered(M.metric_stream(spark, SF), monitoring.thresholds(spark))
    a = a.withColumn("cooldown", F.lit(7200)).select("id", "ts", "metric", "level", "value", "threshold", "cooldown")
    got = _run(spark, state.cooled(_in_parts(spark, a, str(tmp_path / "in"), 5, END, id=-1, metric="end", level="end", cooldown=1), "0 seconds"), "cooled_state")
    plain = monitoring.cooled(a)
    assert sorted(map(tuple, got.where("id >= 0").collect())) == sorted(map(tuple, plain.select("id", "metric", "level").collect()))
    assert 0 < plain.count() < a.count()


def test_until_resolved_state(spark, tmp_path):
    state.rocksdb(spark)
    e = Q._monitored(spark, SF)
    got = _run(spark, state.until_resolved(_in_parts(spark, e, str(tmp_path / "in"), 5, END, id=-1, metric="end", resolve=True), "0 seconds"), "resolved")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, monitoring.until_resolved(e).select("id", "metric").collect()))


def test_snapshots_of_expired_buffers(spark, tmp_path):
    """Each conversation's turns at the time that its buffer began; turns after its end begin another one."""
    state.rocksdb(spark)
    t = M.table(spark, SF, "conversations")
    start = F.lit(AS_OF).cast("timestamp") - F.make_interval(hours=F.col("conv_id").cast("int"))
    t = t.select(F.col("conv_id").alias("session_id"), start.alias("ts"), "turn", "role", "text")
    late = t.orderBy(F.desc("session_id")).limit(1).withColumn("ts", F.expr("ts + interval 3 hours"))
    got = _run(spark, state.snapshots(_in_parts(spark, t.unionByName(late), str(tmp_path / "in"), 5, AS_OF + timedelta(seconds=1), session_id=-1, turn=1), 2, "0 seconds"), "snapshots")
    plain = dml.buffer_snapshots(M.wm_buffer(spark, SF).withColumn("expires_at", F.expr("created_at + interval 2 hours")), AS_OF)
    again = f"mem_wm_{late.first()['session_id']}"
    rows = {(r["id"], r["content"]) for r in got.collect()}
    assert {r for r in rows if r[0] != again} == {(r["id"], r["content"]) for r in plain.collect() if r["id"] != again}
    assert len(rows) > 3 and sum(r[0] == again for r in rows) == 2


def test_cycle_in_a_stream(spark, tmp_path):
    r, e = M.request_log(spark, SF), M.error_log(spark, SF).select("ts")
    left = _in_parts(spark, r, str(tmp_path / "r"), 3, END, hit=False, lookup=False)
    right = _in_parts(spark, e, str(tmp_path / "e"), 3, END)
    got = _run(spark, state.monitoring_cycle(left, right, "1 minute"), "cycle")
    plain = {tuple(x) for x in monitoring.cycle(r, e).collect()}
    found = {tuple(x) for x in got.collect() if x["start"].year == 2024}
    assert found <= plain and len(found) >= len(plain) - 2  # the last windows wait for a watermark beyond them


def test_index_of_a_stream(spark, tmp_path):
    """Memories and deletions as a stream of changes: the index is as one made of what is left."""
    m = M.memory_item(spark, SF).limit(30)
    ops = m.select(F.lit("upsert").alias("op"), "*").unionByName(m.limit(7).select(F.lit("delete").alias("op"), "*"))
    path = str(tmp_path / "in")
    for op in ("upsert", "delete"):
        ops.where(f"op = '{op}'").coalesce(1).write.mode("append").parquet(path)
    index = SearchIndex(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(path)
    pipelines.follow(stream, index, str(tmp_path / "cp")).awaitTermination(180)
    left = m.join(ops.where("op = 'delete'").select("id"), "id", "left_anti")
    assert sorted(map(tuple, index.postings().select("id", "term", "tf").collect())) == sorted(map(tuple, postings(left).collect()))
