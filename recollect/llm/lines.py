"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, finished, scratch, stored, text_slices, texts, writing

MIN_CHARS = 10
STRIP = b" \t\n\x0b\x0c\r"
REFS = "shard int, key binary, doc_id bigint"
SLOTS, KICKS = 4, 500
#: Filters of a shard, one above the other, before an index is compacted, and references that a shard then has.
MOST_FILTERS, SHARD_REFS = 8, 1 << 20


class CuckooFilter:
    """A set of 16-byte keys with false positives (about 1 in 8000) but no false negatives; keys can be deleted.

    Four slots of 16 bits a bucket. A key's two buckets differ by a hash of its fingerprint, so either one
    gives the other. Whole arrays of distinct keys are put in at once; those that find both buckets full are
    moved in by kicks. A filter sized for its keys is at most 80 % full.
    """

    def __init__(self, capacity: int = 0, blob: bytes | None = None):
        if blob is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.8))))
            self.slots = np.zeros((buckets, SLOTS), np.uint16)
        else:
            self.slots = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these distinct keys. In a small one the kicks may find no place; it then starts again at twice the size."""
        capacity = len(keys)
        for _ in range(12):
            new = cls(capacity)
            try:
                new.insert(keys)
                return new
            except OverflowError:
                capacity = 2 * max(capacity, SLOTS)
        raise OverflowError("more keys share one fingerprint and place than two buckets hold")

    def blob(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        one = (keys[:, 0] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket, mark):
        return bucket ^ ((np.asarray(mark, np.int64) * 0x5BD1E995 >> 7) & (len(self.slots) - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        mark, one, two = self._places(keys)
        left = np.arange(len(keys))
        for where in (one, two):
            left = left[np.argsort(where[left], kind="stable")]
            b = where[left]
            first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(b)), 0)) if len(b) else b
            rank = np.arange(len(b)) - start
            empty = self.slots[b] == 0
            fits = rank < empty.sum(1)
            slot = np.argmax(np.cumsum(empty, 1) == (rank + 1)[:, None], 1)
            self.slots[b[fits], slot[fits]] = mark[left[fits]]
            left = left[~fits]
        for i in left:
            self._kick(int(two[i]), mark[i])

    def _kick(self, bucket: int, mark) -> None:
        for turn in range(KICKS):
            empty = np.flatnonzero(self.slots[bucket] == 0)
            if len(empty):
                self.slots[bucket, empty[0]] = mark
                return
            slot = (turn + int(mark)) % SLOTS
            self.slots[bucket, slot], mark = mark, self.slots[bucket, slot]
            bucket = int(self._other(bucket, mark))
        raise OverflowError("cuckoo filter is full; give it its number of keys as capacity")

    def delete(self, keys: np.ndarray) -> None:
        """keys must have been inserted."""
        mark, one, two = self._places(keys)
        for m, places in zip(mark, zip(one, two, strict=True), strict=True):
            for b in places:
                found = np.flatnonzero(self.slots[b] == m)
                if len(found):
                    self.slots[b, found[0]] = 0
                    break


def _keys(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint64).reshape(-1, 2)


def line_key(line: bytes) -> bytes | None:
    """The digest of a line's key, None for keys under 10 code points."""
    key = line.strip(STRIP).lower()  # bytes: A-Z only
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


def _doc_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        ids, keys = [], []
        for doc, text in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True):
            own = {k for line in text.split(b"\n") if (k := line_key(line))}
            keys += own
            ids += [doc] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])


def line_keys(docs: DataFrame, shards: int) -> DataFrame:
    """shard, key, doc_id: each document's distinct line keys."""
    keyed = docs.select("doc_id", "text").mapInArrow(_doc_keys, "key binary, doc_id bigint")
    return keyed.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "doc_id")


def _insert(mine: pd.DataFrame, stored_filters: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(mine["key"])
    seen = np.zeros(len(keys), bool)
    for blob in stored_filters["blob"]:
        seen |= CuckooFilter(blob=blob).contains(keys)
    fresh = keys[~seen]
    shard = int(mine["shard"].iloc[0]) if len(mine) else -1
    shared = mine[seen | (mine["n"].to_numpy() > 1)]
    out = pd.DataFrame({"shard": shared["shard"], "key": shared["key"], "blob": None})
    if len(fresh):
        out = pd.concat([out, pd.DataFrame({"shard": [shard], "key": [None], "blob": [CuckooFilter.of(fresh).blob()]})])
    return out


def _built(mine: pd.DataFrame) -> pd.DataFrame:
    """One filter of a shard's distinct keys."""
    return pd.DataFrame({"shard": mine["shard"].iloc[:1].to_numpy(), "blob": [CuckooFilter.of(_keys(mine["key"])).blob()]})


def _delete(keyed: pd.DataFrame, stored_filters: pd.DataFrame) -> pd.DataFrame:
    """keyed: a shard's keys, and whether any document still holds them.

    A key that a filter only seemed to hold takes another key's fingerprint with it, so held keys that no filter has
    any more are put into one of their own.
    """
    held = keyed["held"].to_numpy(bool)
    keys = _keys(keyed["key"][~held])
    left = _keys(keyed["key"][held])
    lost, out = np.ones(len(left), bool), []
    for blob in stored_filters["blob"]:
        f = CuckooFilter(blob=blob)
        here = f.contains(keys)
        f.delete(keys[here])
        keys = keys[~here]
        lost &= ~f.contains(left)
        out.append(f.blob())
    if lost.any():
        out.append(CuckooFilter.of(left[lost]).blob())
    shard = int((stored_filters if len(stored_filters) else keyed)["shard"].iloc[0])
    return pd.DataFrame({"shard": shard, "key": None, "blob": out})


class LineIndex:
    """Which documents hold which line, and a filter over the lines. It lives in a folder and goes on where it ended.

    * ``refs``: exact reference counts, one row (shard, key, doc_id) for a document and each line key it holds, each
      file sorted by shard, so that readers of some shards skip the rest.
    * ``filters``: per shard of the key space, cuckoo filters of the keys inserted so far. A batch adds a
      filter of the keys that no filter holds yet.
    * ``shared``: keys that were in more than one document, or that a filter held when they came again.

    The filters decide what is counted: references whose key is not in ``shared`` stand for lines of one document
    and go no further. A deletion notes the references that go (``gone``) and rewrites the filters of their shards alone,
    without the keys that no document holds any more. Later decisions are as if the document had never been
    there. Changes are folders beside the old ones, named in a log, so one that fails half-way leaves the index as it was.
    Once MOST_FILTERS batches have added filters the index is compacted: one filter a shard, of the keys that are
    held now, and as many more shards as its references ask for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64):
        self.spark = spark
        self.path = path or scratch(spark, "lines")
        self.log = self._read_log()
        if not self.log:
            self._note("made", shards)
        self.shards = [x for kind, x in self.log if kind == "made"][-1]

    def _read_log(self) -> list[tuple[str, int]]:
        """(kind, number) of every change so far: the number of shards, then the versions of folders."""
        try:
            rows = self.spark.read.schema("n bigint, kind string, number int").json(f"{self.path}/log").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [(r["kind"], r["number"]) for r in sorted(rows)]

    def _note(self, *changes) -> None:
        """Adds (kind, number, kind, number, ...) to the log at once."""
        pairs = list(zip(changes[::2], changes[1::2], strict=True))
        rows = [(len(self.log) + i, k, int(x)) for i, (k, x) in enumerate(pairs)]
        self.spark.createDataFrame(rows, "n bigint, kind string, number int").coalesce(1).write.mode("append").json(f"{self.path}/log")
        self.log += pairs

    def _put(self, df: DataFrame, kind: str) -> tuple[int, DataFrame]:
        version = 1 + max([x for k, x in self.log if k != "made"], default=0)
        path = f"{self.path}/{kind}-{version}"
        with writing(self.spark):
            df.write.mode("overwrite").parquet(path)
        return version, self.spark.read.schema(df.schema).parquet(path)

    def _parts(self, kind: str, schema: str) -> list[tuple[int, DataFrame]]:
        since = max([x for k, x in self.log if k == "cleared"], default=0)
        return [(x, self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-{x}")) for k, x in self.log if k == kind and x >= since]

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    @property
    def refs(self) -> DataFrame:
        """The references that no later deletion took away."""
        gone = self._parts("gone", REFS)
        out = []
        for version, part in self._parts("refs", REFS):
            later = [g for v, g in gone if v > version]
            out.append(part.join(self._all(later, REFS).select("key", "doc_id"), ["key", "doc_id"], "left_anti").select("shard", "key", "doc_id") if later else part)
        return self._all(out, REFS)

    @property
    def filters(self) -> DataFrame:
        """Each shard's filters since it was last rewritten."""
        schema = "shard int, blob binary"
        every = self._all([p.withColumn("version", F.lit(v)) for v, p in self._parts("filters", schema)], schema + ", version int")
        anew = [p.withColumn("since", F.lit(v)) for v, p in self._parts("rewritten", "shard int")]
        if not anew:
            return every.select("shard", "blob")
        last = self._all(anew, "shard int, since int").groupBy("shard").agg(F.max("since").alias("since"))
        return every.join(last, "shard", "left").where("version >= coalesce(since, 0)").select("shard", "blob")

    @property
    def shared(self) -> DataFrame:
        return self._all([p for _, p in self._parts("shared", "shard int, key binary")], "shard int, key binary")

    def insert(self, docs: DataFrame) -> None:
        version, new = self._put(line_keys(docs, self.shards).sortWithinPartitions("shard", "key"), "refs")
        counts = new.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n"))
        seen = counts.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_insert, "shard int, key binary, blob binary")
        out = stored(seen, "line-batch")
        self._put(out.where("blob is not null").select("shard", "blob"), "filters")
        self._put(out.where("key is not null").select("shard", "key"), "shared")
        finished(out)
        self._note("refs", version, "filters", version, "shared", version)
        if len(self._parts("filters", "shard int, blob binary")) > MOST_FILTERS:
            self.compact()

    def compact(self, shard_refs: int | None = None) -> None:
        """Rewrites the index without what is gone: references and shared keys as one table each, one filter a shard, and the
        number of shards doubled until one has shard_refs (SHARD_REFS) references or fewer. Tables read from it before can't be
        read any more."""
        old = [(k, x) for k, x in self.log if k in ("refs", "gone", "filters", "rewritten", "shared")]
        n, shards = self.refs.count(), self.shards
        while n > shards * (shard_refs or SHARD_REFS):
            shards *= 2
        shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
        refs = self.refs.select(shard, "key", "doc_id").repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
        version, refs = self._put(refs, "refs")
        self._put(refs.select("shard", "key").distinct().groupBy("shard").applyInPandas(_built, "shard int, blob binary"), "filters")
        # A shared key that one document or none holds now may be forgotten: its filter finds it again.
        self._put(self.shared.select("key").distinct().join(refs.select("key"), "key", "left_semi").select(shard, "key"), "shared")
        self._note("cleared", version, "made", shards, "refs", version, "filters", version, "shared", version)
        self.shards = shards
        for k, x in old:
            delete(self.spark, f"{self.path}/{k}-{x}")

    def delete(self, doc_ids: DataFrame) -> None:
        """doc_ids: the documents to take away."""
        refs = self.refs
        version, gone = self._put(refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("shard", "key", "doc_id"), "gone")
        _, touched = self._put(gone.select("shard").distinct(), "rewritten")
        mine = refs.join(touched, "shard", "left_semi")
        held = mine.join(gone.select("key", "doc_id"), ["key", "doc_id"], "left_anti").select("shard", "key").distinct()
        lost = gone.select("shard", "key").distinct().join(held, ["shard", "key"], "left_anti")
        keyed = held.withColumn("held", F.lit(True)).unionByName(lost.withColumn("held", F.lit(False)))
        filters = self.filters.join(touched, "shard", "left_semi")
        changed = keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_delete, "shard int, key binary, blob binary")
        self._put(changed.select("shard", "blob"), "filters")
        self._note("gone", version, "rewritten", version, "filters", version)

    def drops(self) -> DataFrame:
        """doc_id, keys: the repeated keys whose lines a document loses, all in one array."""
        # Tables that are joined are written out, so that both sides are plain exchanges and a hot line's rows can be split.
        shared = stored(self.shared.select("key").distinct(), "shared-lines")
        refs = stored(self.refs.select("key", "doc_id").join(shared, "key", "left_semi"), "shared-refs")
        counted = refs.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
        repeated = stored(counted.select("key", "owner"), "repeated-lines")
        finished(shared)
        lost = refs.join(repeated, "key").where("doc_id <> owner")
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _rebuild(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            n, dropped, kept = [], [], []
            for text, lost in zip(texts(part.column("text")), part.column("keys").to_pylist(), strict=True):
                lines = text.split(b"\n")
                n.append(len(lines))
                if lost:
                    lost = set(lost)
                    lines = [x for x in lines if line_key(x) not in lost]
                dropped.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
            arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                # A document that loses nothing keeps its text as it is, null included.
                old = part.column("text").to_pylist()
                arrays.append(pa.array([o if not d else k.decode() for o, d, k in zip(old, dropped, kept, strict=True)], pa.string()))
                names.append("text")
                arrays += [part.column(x) for x in part.schema.names if x.startswith("_")]
                names += [x for x in part.schema.names if x.startswith("_")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def line_dedup(docs: DataFrame, index: LineIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs.

    Lines whose key (stripped, A-Z in lower case, 10 code points or more) is in two documents or more stay only
    in the one with the smallest doc_id, there all of them. Null or empty text is one empty line. Rows of a
    repeated doc_id are one document; a null doc_id never owns a line and is not counted as a document. A long
    text is split in the one task that holds its row. Other columns are not read, so their names can't clash. An index
    made here is deleted once the lines to drop are known.
    """
    own = index is None
    index = index or LineIndex(docs.sparkSession, shards=shards_for(docs))
    fill(index, docs, batches)
    drops = stored(index.drops(), "line-drops")
    if own:
        delete(docs.sparkSession, index.path)
    joined = docs.select("doc_id", "text").join(drops, "doc_id", "left")
    return joined.mapInArrow(_rebuild(False), "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def shards_for(docs: DataFrame, least: int = 64, shard_bytes: int = 64 << 20) -> int:
    """Shards enough for the lines of all texts, so that what a task holds of one does not grow with the input."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, -(-n_bytes // shard_bytes))


def fill(index: LineIndex, docs: DataFrame, batches: int) -> None:
    cuts = docs.select("doc_id").dropna().approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = docs.where("doc_id is not null")
        part = part if low is None else part.where(F.col("doc_id") >= low)
        index.insert(part if high is None else part.where(F.col("doc_id") < high))


def dedup_texts(docs: DataFrame, batches: int = 2) -> DataFrame:
    """docs with their repeated lines gone from text; every column stays. Rows and cases are line_dedup's; a text that
    loses nothing stays as it is, null included."""
    index = LineIndex(docs.sparkSession, shards=shards_for(docs))
    fill(index, docs, batches)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("x")]).alias("_rest"))
    drops = stored(index.drops(), "line-drops")
    delete(docs.sparkSession, index.path)
    joined = packed.join(drops, "doc_id", "left")
    schema = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, text string, _rest " + packed.schema["_rest"].dataType.simpleString()
    out = joined.mapInArrow(_rebuild(True), schema)
    return out.select(*[F.col(f"_rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns])
