"""Full-text search index that follows its memories: immutable runs of postings, tombstones, versions, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Versions, delete, smaller, writing
from .search import indexed

POSTINGS = "id string, term string, tf bigint, dl bigint, head boolean, v bigint, bucket int"
DOCS = "id string, dl bigint, v bigint"
DEAD = "id string, v bigint"
#: Postings that one bucket of a run should have.
BUCKET_ROWS = 4_000_000
MOST_BUCKETS = 4096
#: Shuffled bytes that a task of a write sorts, or less if the session wants less (about eight times as many in memory).
PART_BYTES = 32 << 20
#: Pieces that postings are dealt into by id, at most.
MOST_PIECES = 1 << 16
#: So many query terms are pushed to the scan one by one; for more of them their buckets are.
MOST_TERMS = 1000


class SearchIndex:
    """An inverted index in a folder.

    A change writes one run: the postings of new texts in folders by bucket of the term, sorted by term; the new memories'
    lengths; and tombstones (id, v) for the versions that they or deletions replace. A posting counts if no tombstone names
    its version, so an id that is deleted and comes back is found again. A manifest names the runs and carries the number
    of memories and of tokens. Runs whose sizes have come close to each other are merged, without what is
    dead by then, so the number of runs stays logarithmic. Memories without any token are not in it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, f"{path}/manifest")
        self.state: dict = self.versions.current() or {"runs": [], "buckets": 1, "docs": 0, "tokens": 0, "batch": -1}

    def _read(self, name: str, schema: str, runs=None) -> DataFrame:
        out = None
        for run in self.state["runs"] if runs is None else runs:
            one = self.spark.read.schema(schema).parquet(f"{self.path}/runs/{run['name']}/{name}")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _alive(self, rows: DataFrame) -> DataFrame:
        if not any(run["dead"] for run in self.state["runs"]):
            return rows
        return rows.join(self._read("dead", DEAD), ["id", "v"], "left_anti")

    def docs(self) -> DataFrame:
        """id, dl, v of every memory as it is now."""
        return self._alive(self._read("docs", DOCS))

    def totals(self) -> tuple[int, float | None]:
        """How many memories there are and their mean length, as the manifest has them."""
        n = self.state["docs"]
        return n, self.state["tokens"] / n if n else None

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """id, term, tf, dl of the memories as they are now: all, or of the terms (term) only.

        Few terms go to the scan as they are, which then skips files and row groups; else the numbers of their buckets,
        a bounded set, leave the other buckets unread.
        """
        rows = self._read("postings", POSTINGS)
        if terms is not None:
            asked = terms.select("term").distinct()
            some = [r["term"] for r in asked.limit(MOST_TERMS + 1).collect()]
            if len(some) <= MOST_TERMS:
                buckets = self._buckets(self.spark.createDataFrame([(t,) for t in some], "term string"))
                rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(some))
            else:
                rows = rows.where(F.col("bucket").isin(self._buckets(asked))).join(asked, "term", "left_semi")
        return self._alive(rows).select("id", "term", "tf", "dl")

    def pieces(self) -> int:
        """How many pieces of BUCKET_ROWS postings there are."""
        return min(MOST_PIECES, sum(run["rows"] for run in self.state["runs"]) // BUCKET_ROWS + 1)

    def available(self, source: str | None = None) -> bool:
        """Whether there is anything to search in, and if a source is named, whether it is of that."""
        return self.state["docs"] > 0 and source in (None, self.state.get("source"))

    def status(self) -> dict:
        """available, table_exists, record_count and the number of the current version."""
        there = bool(self.state["runs"])
        return {"available": self.available(), "table_exists": there, "record_count": self.state["docs"], "version": self.state.get("v", 0)}

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.state["buckets"])).cast("int")

    def _buckets(self, terms: DataFrame) -> list[int]:
        return [r["b"] for r in terms.select(self._bucket().alias("b")).distinct().collect()]

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, batch: int | None = None, source: str | None = None) -> None:
        """Takes in new or changed memories and deletions (id) as one version.

        A memory that is in both is new. batch: the number of a stream's micro-batch; one that was applied already is
        passed over, so a repeated batch changes nothing. source: a name for the state of the tables that the index then is of.
        """
        if batch is not None and batch <= self.state["batch"]:
            return
        v = self.state.get("v", 0) + 1
        changed = None
        for df in (upserts, deletes):
            if df is not None:
                ids = df.select("id").distinct()
                changed = ids if changed is None else changed.unionByName(ids).distinct()
        if changed is None:
            return
        if not self.state["runs"] and upserts is not None:
            rows = upserts.select(F.sum(F.length("content"))).first()[0] or 0
            self.state["buckets"] = max(1, min(MOST_BUCKETS, rows // 8 // BUCKET_ROWS + 1))
        dead = self.docs().join(changed, "id", "left_semi")
        new = None if upserts is None else indexed(upserts)
        run = self._write(new, None, dead.select("id", "v"), v)
        gone = dead.agg(F.count(F.lit(1)), F.sum("dl")).first()
        state = dict(self.state, runs=[*self.state["runs"], run], v=v, batch=self.state["batch"] if batch is None else batch)
        state["source"] = source
        state["docs"] += run["docs"] - gone[0]
        state["tokens"] += run["tokens"] - (gone[1] or 0)
        self._commit(state)
        runs = self.state["runs"]
        first = len(runs) - 1
        while first and 2 * sum(r["rows"] for r in runs[first:]) >= runs[first - 1]["rows"]:
            first -= 1
        if first < len(runs) - 1:
            self.compact(first)

    def _write(self, postings: DataFrame | None, docs: DataFrame | None, dead: DataFrame, v: int | None) -> dict:
        name = uuid.uuid4().hex
        base = f"{self.path}/runs/{name}"
        if postings is None:
            postings, docs = self.spark.createDataFrame([], POSTINGS), self.spark.createDataFrame([], DOCS)
        if v is not None:
            postings = postings.withColumn("v", F.lit(v).cast("long"))
        read = lambda n, s: self.spark.read.schema(s).parquet(f"{base}/{n}")
        with writing(self.spark), smaller(self.spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", PART_BYTES):
            # Rebalancing keeps a bucket's rows together but cuts the one of a very frequent term into files.
            p = postings.select("id", "term", "tf", "dl", "head", "v", self._bucket().alias("bucket")).hint("rebalance", "bucket")
            p.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{base}/postings")
            if docs is None:  # from what was written, so that texts fall into tokens once
                docs = read("postings", POSTINGS).where("head").select("id", "dl", "v")
            docs.write.parquet(f"{base}/docs")
            dead.write.parquet(f"{base}/dead")
        n, tokens = read("docs", DOCS).agg(F.count(F.lit(1)), F.sum("dl")).first()
        return {"name": name, "docs": n, "tokens": tokens or 0, "rows": read("postings", POSTINGS).count() + n, "dead": read("dead", DEAD).count()}

    def compact(self, first: int = 0) -> None:
        """Merges the runs from this one on into one, without what is dead."""
        runs = self.state["runs"][first:]
        postings = self._alive(self._read("postings", POSTINGS, runs))
        docs = self._read("docs", DOCS, runs)
        # Tombstones of older runs' memories stay.
        dead = self._read("dead", DEAD, runs).join(docs, ["id", "v"], "left_anti").distinct()
        run = self._write(postings.drop("bucket"), self._alive(docs), dead, None)
        self._commit(dict(self.state, runs=[*self.state["runs"][:first], run]))

    def _commit(self, state: dict) -> None:
        self.versions.commit(state)
        self.state = state

    def vacuum(self) -> None:
        """Deletes the runs that the current version does not name; plans made from older versions can't be run after it."""
        used = {run["name"] for run in self.state["runs"]}
        for name in self.versions.names(f"{self.path}/runs"):
            if name not in used:
                delete(self.spark, f"{self.path}/runs/{name}")

    def drop(self) -> None:
        delete(self.spark, self.path)
        self.state = {"runs": [], "buckets": 1, "docs": 0, "tokens": 0, "batch": -1}
