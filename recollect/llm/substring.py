"""Substring dedup of word windows against a log-structured index of fingerprints.

The index holds, for the windows of all documents so far, one entry per minimiser (an eight-word gram) and
surroundings (all the windows that share that minimiser): a hash, a digest and the first document. Each batch adds one
immutable run of entries, sorted by hash; a new batch is merge-joined with every run, what matches is verified on the
texts' windows, and runs are compacted into one as they grow in number.

Surroundings and single windows are compared by 96 bits of an XXH3 digest of their words, one space between; two different
ones of n are taken for equal with a chance of n * n / 2 ** 97. Gram hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Log, aligned, bucketed, delete, finished, identified, scratch, stored, text_slices, texts, writing
from .repeats import Hashes, joined, least, ranges, runs, starts_inside
from .suffix import SPAN, _lists, digests, flat

WINDOW = 50
GRAM = 8
SLICE = 2 << 20
PLACE = "gram bigint, around bigint, beyond int, doc_id bigint, twin int, pos int"
ENTRY = ["gram", "around", "beyond"]
#: Entries of one gram in a run that are one part; a gram with more is split, so that no bucket holds a hot one whole.
PART = 4096
#: Text whose entries are one bucket.
BUCKET_BYTES = 256 << 20


class Layout:
    """Word windows of some texts end to end, named by their first word."""

    def __init__(self, bodies: list[bytes], window: int):
        words = [b.split() for b in bodies]  # bytes: the six ASCII white-space characters only
        self.words = words
        self.offsets = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
        n = int(self.offsets[-1])
        values = np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, n)
        self.window, gram = window, min(GRAM, window)
        at = np.arange(max(0, n - gram + 1))
        self.grams = Hashes(values).of(at, at + gram)
        low = least(self.grams, window - gram + 1)
        self.windows = starts_inside(self.offsets, window)
        first = low[self.windows]
        self.run_first, self.run_end = runs(first)
        self.anchor = first[self.run_first]
        # Every word with one space after it, and where each starts.
        self.spaced = np.frombuffer(b" ".join([w for own in words for w in own] + [b""]), np.uint8)
        self.byte = np.r_[0, np.cumsum(np.fromiter((len(w) + 1 for own in words for w in own), np.int64, n))]

    def digests(self, start: np.ndarray, end: np.ndarray, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return digests(self.spaced, self.byte[start], self.byte[end], seed)

    def fingerprints(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """document, gram and digest of the surroundings, and pos of each minimiser."""
        low, high = self.windows[self.run_first], self.windows[self.run_end - 1] + self.window
        doc = np.searchsorted(self.offsets, self.anchor, "right") - 1
        return doc, [self.grams[self.anchor].view(np.int64), *self.digests(low, high, self.anchor - low)], (self.anchor - self.offsets[doc]).astype(np.int32)


def _fingerprints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            doc, entry, pos = Layout(texts(part.column("text")), window).fingerprints()
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*map(pa.array, entry), part.column("doc_id").take(pick), part.column("twin").take(pick), pa.array(pos)], [*ENTRY, "doc_id", "twin", "pos"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in a folder, which goes on where it ended.

    A run is two tables. ``entries``: each gram with its surroundings and the smallest doc_id that has them, bucketed by
    gram and part and sorted. ``grams``: one row a gram, with the number of its entries and their range, bucketed by gram
    and sorted. Both are read bucket by bucket without a shuffle, and as each bucket is one file, without a sort. A gram of
    more than PART entries has several parts, so a passage that very many documents go on from differently is
    spread over the buckets. The texts are not copied: whoever opens an index that has runs gives the documents
    that they came from as docs (doc_id, text).
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, most_runs: int = 4, buckets: int | None = None, docs: DataFrame | None = None):
        self.spark, self.window, self.most_runs = spark, window, most_runs
        self.path = path or scratch(spark, "fingerprints")
        self.log = Log(spark, f"{self.path}/log")
        if not self.log.rows:
            self.log.add("buckets", buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "window", window)
        self.buckets, self.window = self.log.numbers("buckets")[0], self.log.numbers("window")[0]
        self.docs = None if docs is None else identified(docs).drop("doc")
        self._names: dict[tuple[str, int], str] = {}
        if self.runs and docs is None:
            raise ValueError("this index has runs: give the documents that they came from")

    @property
    def runs(self) -> list[int]:
        """The numbers of the runs since the last compaction, the compacted one first."""
        compact = max(self.log.numbers("compacted"), default=-1)
        return [x for x in self.log.numbers("run") if x >= compact]

    def table(self, kind: str, run: int) -> DataFrame:
        if (kind, run) not in self._names:
            schema, keys, order = {
                "entries": ("gram bigint, part int, around bigint, beyond int, doc_id bigint", "gram, part", "gram, part, around, beyond"),
                "grams": ("gram bigint, low bigint, high bigint, n bigint, parts int", "gram", "gram"),
            }[kind]
            self._names[kind, run] = bucketed(self.spark, f"{self.path}/{kind}-{run}", schema, keys, order, self.buckets)
        return self.spark.table(self._names[kind, run])

    def close(self) -> None:
        """Forgets the tables' names; the files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()

    @staticmethod
    def _firsts(rows: DataFrame) -> DataFrame:
        """Each gram and its surroundings with the smallest doc_id that has them, and in how many rows they are."""
        return rows.groupBy(*ENTRY).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))

    def _parted(self, entries: DataFrame, run: int) -> DataFrame:
        """entries with the part that their gram and surroundings have in a run."""
        many = self.table("grams", run).where("parts > 1").select("gram", "parts")
        return entries.join(many, "gram", "left").withColumn("part", F.coalesce(F.pmod("around", "parts"), F.lit(0)).cast("int")).drop("parts")

    def _write(self, firsts: DataFrame, run: int) -> None:
        grams = firsts.groupBy("gram").agg(F.min("around").alias("low"), F.max("around").alias("high"), F.count(F.lit(1)).alias("n"))
        grams = grams.withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
        with aligned(self.spark, self.buckets), writing(self.spark):
            for kind, make in (("grams", lambda: grams), ("entries", lambda: self._parted(firsts, run).repartition(self.buckets, "gram", "part"))):
                t = self.table(kind, run)
                make().select(*t.columns).write.insertInto(self._names[kind, run])
                self.spark.catalog.refreshTable(self._names[kind, run])

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Adds a batch (doc_id, text, twin) as a run. Returns notes on windows: of the batch's rows (doc_id, twin, notes: pos,
        settled), and of the history's documents the grams that ask for comparison (doc_id, grams), None without history."""
        if len(self.runs) > self.most_runs:
            self.compact()
        history, run = self.runs, max(self.log.numbers("run"), default=0) + 1
        places = stored(batch.where("doc_id is not null").mapInArrow(_fingerprints(self.window), PLACE), "places")
        firsts = stored(self._firsts(places), "firsts")
        self._write(firsts, run)
        with aligned(self.spark, self.buckets):
            # Grams whose windows differ from place to place: there single windows must be compared.
            known = self.table("grams", run).select("gram", "low", "high")
            for h in history:
                t = self.table("grams", h).select("gram", F.col("low").alias("l"), F.col("high").alias("h"))
                known = known.join(t.hint("merge"), "gram", "left").select("gram", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))
            mixed = stored(known.where("low <> high").select("gram"), "mixed-grams")
            # The history's owners of the batch's entries, and its entries of mixed grams.
            owners, others = [firsts.select(*ENTRY, F.col("doc_id").alias("owner"), "n")], []
            for h in history:
                t = self.table("entries", h).hint("merge")
                owners.append(self._parted(firsts.select(*ENTRY), h).join(t, ["gram", "part", "around", "beyond"]).select(*ENTRY, F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("n")))
                parts = mixed.join(self.table("grams", h).hint("merge"), "gram").select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
                others.append(parts.join(t, ["gram", "part"]).select("doc_id", "gram"))
            owner = reduce(DataFrame.unionByName, owners)
            if history:
                owner = owner.groupBy(*ENTRY).agg(F.min("owner").alias("owner"), F.sum("n").alias("n"))
            # An entry that one row alone has says something only where its gram is mixed.
            owner = owner.join(mixed.withColumn("mixed", F.lit(True)), "gram", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
            owner = stored(owner.where("n > 1 or mixed").drop("n"), "owners")
            asked = stored(reduce(DataFrame.unionByName, others).groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "history-grams") if others else None
        finished(mixed, firsts)
        # Both sides are written out, so that a hot gram's rows can be split. An owner's own places are all compared.
        mine = places.join(owner, ENTRY).where("owner < doc_id or mixed")
        mine = mine.select("doc_id", "twin", "pos", (F.col("owner") < F.col("doc_id")).alias("settled"))
        self.docs = batch if self.docs is None else self.docs.unionByName(batch)
        self.log.add("run", run)
        notes = stored(mine.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("pos", "settled")).alias("notes")), "notes")
        finished(places, owner)
        return notes, asked

    def compact(self) -> None:
        """Merges all runs into one."""
        old, run = self.runs, max(self.log.numbers("run"), default=0) + 1
        every = reduce(DataFrame.unionByName, [self.table("entries", r).select(*ENTRY, "doc_id") for r in old])
        firsts = stored(self._firsts(every), "compacted")
        self._write(firsts, run)
        self.log.add("run", run, "compacted", run)
        finished(firsts)
        for r in old:
            for kind in ("entries", "grams"):
                self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop((kind, r))}") if (kind, r) in self._names else None
                delete(self.spark, f"{self.path}/{kind}-{r}")


FOUND = (
    "hash bigint, more int, doc_id bigint, current boolean, twin int, n_words bigint, n_removed bigint, kept_sha256 string, text binary, "
    "settled array<struct<start:int,end:int>>, asked array<struct<start:int,end:int>>"
)
_TYPES = {
    "hash": pa.int64(), "more": pa.int32(), "doc_id": pa.int64(), "current": pa.bool_(), "twin": pa.int32(), "n_words": pa.int64(), "n_removed": pa.int64(),
    "kept_sha256": pa.string(), "text": pa.binary(), "settled": SPAN, "asked": SPAN,
}


def _found(**given) -> pa.RecordBatch:
    n = len(given["doc_id"])
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in _TYPES.items()], list(_TYPES))


def _kept(words: list[bytes], start: np.ndarray, end: np.ndarray) -> tuple[int, int, str]:
    """n_words, n_removed, kept_sha256."""
    start, end = joined(start, end)
    kept, at = [], 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept += words[at:s]
        at = e
    kept += words[at:]
    return len(words), int((end - start).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def _windows(window: int):
    """For each document with its notes: its final row, or where single windows are in question its text, its settled
    intervals, the ranges of those windows' starts and, a row each, their digests. Of documents of the history, only the
    digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            current = part.column("current").to_numpy(zero_copy_only=False).astype(bool)
            bodies = texts(part.column("text"))
            n_notes, notes = flat(part.column("notes"))
            pos, settled = (notes.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "settled"))
            settled = settled.astype(bool)
            n_grams, grams = flat(part.column("grams"))
            busy = np.flatnonzero(n_notes + n_grams)
            ids, twin = part.column("doc_id"), part.column("twin")
            words: dict[int, list[bytes]] = {}
            start = end = doc = first = last = owner = np.zeros(0, np.int64)
            if len(busy):
                lay = Layout([bodies[i] for i in busy], window)
                words = dict(zip(busy.tolist(), lay.words, strict=True))
                place = np.repeat(lay.offsets[:-1], n_notes[busy]) + pos
                at = np.searchsorted(lay.anchor, place)
                done, ask = np.zeros(len(lay.anchor), bool), np.zeros(len(lay.anchor), bool)
                done[at[settled]] = True
                ask[at[~settled]] = True
                if n_grams.any():  # anchors of the history's documents with a gram in question
                    doc_of = np.searchsorted(lay.offsets, lay.anchor, "right") - 1
                    mine = np.stack([doc_of, lay.grams[lay.anchor].view(np.int64)], 1)
                    ask |= _among(mine, np.stack([np.repeat(np.arange(len(busy)), n_grams[busy]), grams.to_numpy()], 1))
                p = lay.windows[ranges(lay.run_first[ask], lay.run_end[ask])]
                own = np.searchsorted(lay.offsets, p, "right") - 1
                if len(p):
                    hash_, more = lay.digests(p, p + window)
                    pick = pa.array(busy[own])
                    yield _found(hash=hash_, more=more, doc_id=ids.take(pick), current=current[busy[own]])
                    new = np.r_[True, (p[1:] != p[:-1] + 1) | (own[1:] != own[:-1])]
                    first, last, owner = p[new], p[np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]] + 1, own[new]
                    first, last, owner = first - lay.offsets[owner], last - lay.offsets[owner], busy[owner]
                start, end = lay.windows[lay.run_first[done]], lay.windows[lay.run_end[done] - 1] + window
                own = np.searchsorted(lay.offsets, start, "right") - 1
                start, end, doc = start - lay.offsets[own], end - lay.offsets[own], busy[own]
            asked = np.zeros(len(bodies), bool)
            asked[owner] = True
            final = np.flatnonzero(~asked & current)
            if len(final):
                a, b = np.searchsorted(doc, final, "left"), np.searchsorted(doc, final, "right")
                out = [_kept(words[i] if i in words else bodies[i].split(), start[x:y], end[x:y]) for i, x, y in zip(final.tolist(), a, b, strict=True)]
                n, removed, sha = (list(x) for x in zip(*out, strict=True))
                yield _found(doc_id=ids.take(pa.array(final)), n_words=n, n_removed=removed, kept_sha256=sha)
            again = np.flatnonzero(asked & current)
            if len(again):
                pick = pa.array(again)
                lists = [_lists(d, x, y, len(bodies)).take(pick) for d, x, y in ((doc, start, end), (owner, first, last))]
                yield _found(doc_id=ids.take(pick), twin=twin.take(pick), text=[bodies[i] for i in again], settled=lists[0], asked=lists[1])

    return run


def _finish(window: int):
    """From a document's settled intervals, the windows it asked for and the digests that it owns, its final row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            bodies = texts(part.column("text"))
            spans = []
            for c in ("settled", "asked"):
                n, items = flat(part.column(c))
                spans.append((np.r_[0, np.cumsum(n)], items.field("start").to_numpy().astype(np.int64), items.field("end").to_numpy().astype(np.int64)))
            n, items = flat(part.column("owned"))
            at, owned = np.r_[0, np.cumsum(n)], np.stack([items.field("hash").to_numpy(), items.field("more").to_numpy().astype(np.int64)], 1)
            lay = Layout(bodies, window)
            out = []
            for i, words in enumerate(lay.words):
                (a, start, end), (b, low, high) = spans
                asked = ranges(low[b[i] : b[i + 1]], high[b[i] : b[i + 1]])
                mine = np.stack(lay.digests(asked + lay.offsets[i], asked + lay.offsets[i] + window), 1)
                hit = asked[~_among(mine, owned[at[i] : at[i + 1]])]
                out.append(_kept(words, np.r_[start[a[i] : a[i + 1]], hit], np.r_[end[a[i] : a[i + 1]], hit + window]))
            n, removed, sha = (list(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _among(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which rows of two numbers are among the known ones."""
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    return np.isin(np.ascontiguousarray(rows).view(pair).ravel(), np.ascontiguousarray(known).view(pair).ravel())


def dedup_batch(index: FingerprintIndex, batch: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of the batch (doc_id, text), which joins the index.

    A word goes if a window that covers it also starts in a document with a smaller doc_id, of the batch or the history.
    Entries that match in part are verified window by window on the texts, the history's included.
    """
    window = index.window
    batch = identified(batch).drop("doc")
    past = index.docs
    notes, asked = index.add(batch)
    no_grams, no_notes = F.lit(None).cast("array<bigint>").alias("grams"), F.lit(None).cast("array<struct<pos:int,settled:boolean>>").alias("notes")
    # Merge joins, whatever the number of notes: the plan is the same at every size.
    now = batch.join(notes.hint("merge"), ["doc_id", "twin"], "left").select("doc_id", "text", "twin", "notes", no_grams, F.lit(True).alias("current"))
    if past is not None:
        now = now.unionByName(past.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "twin", no_notes, "grams", F.lit(False).alias("current")))
    found = stored(now.mapInArrow(_windows(window), FOUND), "windows")
    finished(notes, *([] if asked is None else [asked]))
    # The smallest doc_id with a window owns it. Each window is one row then, however many documents have it.
    least_, mine = F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("current"), F.col("doc_id"))).alias("mine")
    owned = found.where("hash is not null").groupBy("hash", "more").agg(least_, mine).where("doc_id = mine")
    owned = stored(owned.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "more")).alias("owned")), "owned-windows")
    rest = found.where("text is not null").select("doc_id", "text", "settled", "asked").join(owned.hint("merge"), "doc_id", "left")
    done = rest.mapInArrow(_finish(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return found.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(done)


#: Where the query's batches end, as shares of the documents: the runs of the first two are compacted before the third.
BATCHES = (0.25, 0.5)


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: tuple[float, ...] = BATCHES, most_runs: int = 1) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    Batches by ascending doc_id (batches: the shares at which they end) go through an index one after another; it is
    compacted before a batch that finds more than most_runs runs, and deleted at the end. Null text has no words. Rows with a null doc_id are neither smaller nor larger
    than others: they keep all words. Rows that repeat a doc_id are one document for the comparison and each gets its row.
    Other columns are not read, so their names can't clash. A text is one piece of work and takes about 30 times its size
    while it is looked at.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = FingerprintIndex(spark, window=window, most_runs=most_runs, buckets=max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES)))
    cuts = docs.select("doc_id").dropna().approxQuantile("doc_id", list(batches), 0.01) if batches else []
    edges = [None, *sorted(set(cuts)), None]
    out = None
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") >= low)
        if high is not None:
            part = part.where(F.col("doc_id") < high)
        rows = dedup_batch(index, part)
        out = rows if out is None else out.unionByName(rows)
    index.close()
    delete(spark, index.path)
    if cuts:
        nulls = identified(docs.where("doc_id is null")).withColumns({"current": F.lit(True), "notes": F.lit(None).cast("array<struct<pos:int,settled:boolean>>"), "grams": F.lit(None).cast("array<bigint>")})
        found = nulls.select("doc_id", "text", "twin", "notes", "grams", "current").mapInArrow(_windows(window), FOUND)
        out = out.unionByName(found.select("doc_id", "n_words", "n_removed", "kept_sha256"))
    return out
