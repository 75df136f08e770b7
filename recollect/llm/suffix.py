"""Suffix-array dedup: remove bytes of 400-byte strings that start more than once.

The suffix array is sparse. Minimisers of 190 eight-byte grams cut texts into phrases; a suffix starts at each cut and its
leading tokens are the hashes of its phrases. Two equal 400-byte windows contain the same cuts from the first one's minimiser
on, so their suffixes share leading tokens and stand side by side in sorted order, or have only suffixes between
them that share those tokens too.

1. Splitters sampled from a few documents range-partition the suffixes by leading tokens (ties by what surrounds them, then
   by place, so a hot phrase is split over buckets). Buckets sort by multikey quicksort and compare neighbours; bucket
   edges are compared after.
2. A suffix whose whole surroundings (all windows it stands for) equal a neighbour's settles those windows at once. Where
   neighbours share tokens but not surroundings, a copy begins or ends: only there single windows are digested.
3. Those windows are counted by digest. What comes back to a document are its windows that are alone; the others that it
   asked for are repeated, and it loses the union of all repeated windows.

Surroundings and single windows are compared by 96 bits of an XXH3 digest of their very bytes, for shipping the bytes
would multiply the input: of n strings two different ones are taken for equal with a chance of n * n / 2 ** 97, one in 2,000
for the 10 ** 13 strings of 100 TB. Token hashes only choose what is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finished, identified, stored, text_bytes, text_slices, texts
from .repeats import Hashes, joined, least, mix, ranges, runs, starts_inside

LENGTH = 400
GRAM = 8
SLICE = 1 << 20
TOKENS = 5
SUFFIX = "t0 bigint, t1 int, t2 int, t3 int, t4 int, around bigint, beyond int, pos int, doc bigint, twin int"
#: The place last, its position first: sampled documents part equal suffixes by their positions, as all documents do.
KEY = ["t0", "t1", "t2", "t3", "t4", "around", "beyond", "pos", "doc", "twin"]
AROUND = ["around", "beyond"]
#: Text whose suffixes are one bucket (about as much again in memory, three times while it is sorted).
BUCKET_BYTES = 64 << 20
#: Suffixes sampled for each range, and ranges at most, so the driver's part is bounded; more buckets are cut inside the ranges.
SAMPLED, SPLITTERS = 20, 10_000
#: Rows that a range looks at for the splitters inside it.
LOOK = 1 << 18


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each stretch's digest, as a long and an int column."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    first, second = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
    for lo in range(0, len(start), 65536):
        here = slice(lo, lo + 65536)
        places = zip(start[here].tolist(), end[here].tolist(), strict=True)
        if seed is None:
            found = [digest(view[a:b]) for a, b in places]
        else:
            found = [digest(view[a:b], c) for (a, b), c in zip(places, seed[here].tolist(), strict=True)]
        both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        first[here], second[here] = both[:, 0], both[:, 1] >> 32
    return first, second


class Layout:
    """Cuts, tokens and windows of some texts end to end. Windows are named by their first byte."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data, self.length, self.grams = data, length, length - GRAM + 1
        self.width = max(1, self.grams * 190 // 393)
        padded = np.zeros(len(data) + GRAM, np.uint8)
        padded[: len(data)] = data
        values = mix(np.ndarray(len(data), "<u8", padded.data, strides=(1,)).astype(np.uint64))
        self.hashes = Hashes(values)
        low = least(values, self.width)
        cuts = low[starts_inside(offsets, self.width + GRAM - 1)]
        self.cuts = cuts[runs(cuts)[0]]
        self.cut_doc = np.searchsorted(offsets, self.cuts, "right") - 1
        self.windows = starts_inside(offsets, length)
        self.first = low[self.windows]
        last = low[self.windows + self.grams - self.width]
        rank = np.searchsorted(self.cuts, self.first)
        self.phrases = np.searchsorted(self.cuts, last) - rank
        # The suffixes: cuts that are some window's first; the windows of each are one run.
        self.run_first, self.run_end = runs(self.first)
        self.suffix = self.first[self.run_first]
        self.rank = rank[self.run_first]
        self.offsets = offsets

    def suffixes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each suffix's document, then the tokens, around and pos."""
        token = np.zeros(len(self.cuts) + TOKENS, np.uint64)
        same = self.cut_doc[1:] == self.cut_doc[:-1]
        token[: len(self.cuts) - 1 if len(self.cuts) else 0][same] = self.hashes.of(self.cuts[:-1][same], self.cuts[1:][same])
        t = [token[self.rank]]
        for i in range(1, TOKENS):  # no tokens of the next document
            ok = self.cut_doc[np.minimum(self.rank + i, len(self.cuts) - 1)] == self.cut_doc[self.rank] if len(self.rank) else np.zeros(0, bool)
            t.append(np.where(ok, token[self.rank + i], np.uint64(0)))
        low, high = self.windows[self.run_first], self.windows[self.run_end - 1] + self.length
        around, beyond = digests(self.data, low, high, self.suffix - low)
        doc = self.cut_doc[self.rank] if len(self.rank) else np.zeros(0, np.int64)
        rest = [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in t[1:]]
        return doc, [t[0].view(np.int64), *rest, around, beyond, (self.suffix - self.offsets[doc]).astype(np.int32)]


def suffix_columns(part: pa.RecordBatch, length: int) -> list[np.ndarray]:
    """The columns of KEY for all suffixes of some texts."""
    doc, columns = Layout(*text_bytes(part.column("text")), length).suffixes()
    return [*columns, part.column("doc").to_numpy()[doc], part.column("twin").to_numpy()[doc]]


class Splitters:
    """Range bounds among suffixes: quantiles of the whole rows of a sample."""

    def __init__(self, columns: list[np.ndarray], buckets: int):
        order = np.lexsort(columns[::-1])
        self.buckets = max(1, min(buckets, len(order) // 4))
        at = order[np.arange(1, self.buckets) * len(order) // self.buckets]
        self.columns = [c[at] for c in columns]

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        """Each suffix's bucket; buckets are in the suffixes' order."""
        first = self.columns[0]
        rank = np.searchsorted(first, columns[0], "right")
        tie = np.flatnonzero(np.searchsorted(first, columns[0], "left") < rank)
        if len(tie):  # as many splitters as are not above the row in all its columns
            near = np.flatnonzero(np.isin(first, columns[0][tie]))
            both = [np.r_[s[near], c[tie]] for s, c in zip(self.columns, columns, strict=True)]
            mine = np.r_[np.zeros(len(near), int), np.ones(len(tie), int)]
            order = np.lexsort([mine, *both[::-1]])
            passed = np.cumsum(mine[order] == 0)
            row = order[mine[order] == 1] - len(near)
            value = columns[0][tie[row]]
            rank[tie[row]] = np.searchsorted(first, value, "left") + passed[mine[order] == 1] - np.searchsorted(first[near], value, "left")
        return rank.astype(np.int32)


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            columns = suffix_columns(part, length)
            # By place and document, so that every suffix of texts that are copies of each other has its chance.
            keep = np.flatnonzero(mix((columns[-3].astype(np.int64) + columns[-2] * 31).view(np.uint64)) % np.uint64(8) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], KEY)

    return run


def splitters(d: DataFrame, length: int) -> tuple[Splitters, int]:
    """Bounds for buckets of BUCKET_BYTES of text, SPLITTERS at most, and how many buckets each range between them wants.

    The sample is whole documents, of about a kilobyte of text a range and no fewer than 64, every eighth suffix of theirs: at
    most SAMPLED * SPLITTERS or so come to the driver."""
    n, size = d.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    size = size or 0
    buckets = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    wanted = min(buckets, SPLITTERS) * SAMPLED * 8 * 48  # a suffix stands for 48 bytes
    part = max(1, min(size // max(1, wanted), n // 64))
    rows = d.where(F.pmod(F.xxhash64("doc", "twin"), F.lit(part)) == 0).mapInArrow(_sample(length), SUFFIX)
    t = rows.toArrow()
    bounds = Splitters([t.column(c).to_numpy() for c in KEY], min(buckets, SPLITTERS))
    return bounds, -(-buckets // bounds.buckets) if buckets > SPLITTERS else 1


def _suffixes(length: int, bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            columns = suffix_columns(part, length)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, bounds.value.bucket(columns))], [*KEY, "bucket"])

    return run


def _finer(even: int):
    """The rows of one range, with their buckets in it: its own splitters are quantiles of LOOK rows that come first, which are
    of many documents, as the range is dealt from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(part: pa.RecordBatch, bounds: Splitters) -> pa.RecordBatch:
            columns = [part.column(c).to_numpy() for c in KEY]
            bucket = part.column("bucket").to_numpy() * even + bounds.bucket(columns)
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.array(bucket.astype(np.int32))], [*KEY, "bucket"])

        held: list[pa.RecordBatch] = []
        bounds, rows = None, 0
        for batch in batches:
            if bounds is not None:
                yield dealt(batch, bounds)
                continue
            held.append(batch)
            rows += len(batch)
            if rows >= LOOK:
                bounds = Splitters([pa.Table.from_batches(held).column(c).to_numpy() for c in KEY], even)
                yield from (dealt(b, bounds) for b in held)
                held = []
        if held and rows:
            bounds = Splitters([pa.Table.from_batches(held).column(c).to_numpy() for c in KEY], even)
            yield from (dealt(b, bounds) for b in held)

    return run


def multikey_order(columns: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """The order of rows by columns: three-way quicksort on one column at a time, as for strings."""
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(columns):
            continue
        rows = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = rows[np.lexsort([c[rows] for c in columns[: depth - 1 if depth else None : -1]])]
            continue
        key = columns[depth][rows]
        pivot = np.partition(key[[0, len(key) // 2, -1]], 1)[1]
        below, above = key < pivot, key > pivot
        equal = ~(below | above)
        a, b = lo + int(below.sum()), hi - int(above.sum())
        order[lo:a], order[a:b], order[b:hi] = rows[below], rows[equal], rows[above]
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _compare(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows side by side: whether all that surrounds them is equal, else how many leading tokens are."""
    shared = np.zeros(len(a[0]), np.int32)
    same = np.ones(len(a[0]), bool)
    for x, y in zip(a[:TOKENS], b[:TOKENS], strict=True):
        same &= x == y
        shared += same & (x != 0)  # 0: the text has no further phrase
    whole = same & (a[TOKENS] == b[TOKENS]) & (a[TOKENS + 1] == b[TOKENS + 1])
    return whole, np.where(whole, 0, shared)


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket. Rows with edge 0 say what a suffix shares with a neighbour, the bucket's first and last row have edge 1."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    columns = [t.column(c).to_numpy() for c in KEY]
    order = multikey_order(columns)
    columns = [c[order] for c in columns]
    whole, shared = _compare([c[:-1] for c in columns], [c[1:] for c in columns])
    settled = np.r_[False, whole] | np.r_[whole, False]
    most = np.maximum(np.r_[0, shared], np.r_[shared, 0]).astype(np.int32)
    for rows, edge in ((np.flatnonzero(settled | (most > 0)), 0), (np.unique([0, len(order) - 1]), 1)):
        out = [c[rows] for c in columns] + [settled[rows], most[rows], np.full(len(rows), edge, np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], [*KEY, "settled", "shared", "edge"])


def neighbours(suffixes: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """doc, twin, pos, settled, shared for suffixes that share leading tokens with one beside them in sorted order, and the
    stored table behind it. suffixes: with their bucket."""
    sorted_ = suffixes.repartitionById(buckets, "bucket").select(*KEY).mapInArrow(_bucket, f"{SUFFIX}, settled boolean, shared int, edge int")
    out = stored(sorted_, "suffix-buckets")
    # One or two rows a bucket, so this window is as small as the number of buckets.
    order = Window.partitionBy(F.lit(1)).orderBy(*KEY)
    edges = out.where("edge = 1").select(*KEY)
    both = []
    for move in (F.lag, F.lead):
        other = move(F.struct(*KEY)).over(order).alias("o")
        n = F.lit(0)
        same = F.lit(True)
        e = edges.select(*KEY, other)
        for c in KEY[:TOKENS]:
            same = same & F.col(c).eqNullSafe(F.col(f"o.{c}"))
            n = n + (same & (F.col(c) != 0)).cast("int")
        whole = same
        for c in AROUND:
            whole = whole & F.col(c).eqNullSafe(F.col(f"o.{c}"))
        # A bucket's own first and last row may be compared again here; that only finds what is true.
        both.append(e.where("o is not null").select("doc", "twin", "pos", whole.alias("settled"), F.when(whole, 0).otherwise(n).alias("shared")))
    edge = both[0].unionByName(both[1]).where("settled or shared > 0")
    return out.where("edge = 0").select("doc", "twin", "pos", "settled", "shared").unionByName(edge), out


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FOUND = (
    "doc bigint, twin int, hash bigint, more int, start int, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "text binary, settled array<struct<start:int,end:int>>, asked array<struct<start:int,end:int>>"
)
_TYPES = {
    "doc": pa.int64(), "twin": pa.int32(), "hash": pa.int64(), "more": pa.int32(), "start": pa.int32(), "doc_id": pa.int64(), "n_bytes": pa.int64(),
    "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text": pa.binary(), "settled": SPAN, "asked": SPAN,
}


def _found(**given) -> pa.RecordBatch:
    n = len(given["doc"])
    return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in _TYPES.items()], list(_TYPES))


def _lists(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    """For each of n documents the list of its intervals; doc is in order."""
    items = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), items)


def flat(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of a list column: how many items each row has (null: none), and all items end to end."""
    n = np.array(pc.fill_null(pc.list_value_length(col), 0), np.int64)
    return n, col.flatten()


def _windows(length: int):
    """For each document with the notes on its suffixes: its final row, or where single windows are in question its text,
    its settled intervals, the ranges of those windows' starts and, a row each, their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            data, offsets = text_bytes(part.column("text"))
            key, twin = part.column("doc").to_numpy(), part.column("twin").to_numpy()
            n_notes, notes = flat(part.column("notes"))
            pos, settled, shared = (notes.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "settled", "shared"))
            place = np.repeat(offsets[:-1], n_notes) + pos
            start = end = doc = first = last = owner = np.zeros(0, np.int64)
            if len(place):
                lay = Layout(data, offsets, length)
                at = np.searchsorted(lay.suffix, place)
                done, tokens = np.zeros(len(lay.suffix), bool), np.zeros(len(lay.suffix), np.int64)
                np.logical_or.at(done, at, settled.astype(bool))
                np.maximum.at(tokens, at, shared)
                start, end = lay.windows[lay.run_first[done]], lay.windows[lay.run_end[done] - 1] + length
                doc = np.searchsorted(offsets, start, "right") - 1
                ask = tokens > 0
                single = ranges(lay.run_first[ask], lay.run_end[ask])
                t = np.repeat(tokens[ask], (lay.run_end - lay.run_first)[ask])
                single = single[(t >= TOKENS) | (lay.phrases[single] <= t)]
                p = lay.windows[single]
                if len(p):
                    own = np.searchsorted(offsets, p, "right") - 1
                    hash_, more = digests(data, p, p + length)
                    yield _found(doc=key[own], twin=twin[own], hash=hash_, more=more, start=(p - offsets[own]).astype(np.int32))
                    new = np.r_[True, (p[1:] != p[:-1] + 1) | (own[1:] != own[:-1])]
                    first, last, owner = p[new], p[np.r_[np.flatnonzero(new)[1:] - 1, len(p) - 1]] + 1, own[new]
            asked = np.zeros(len(key), bool)
            asked[owner] = True
            whole = texts(part.column("text"))
            ids = part.column("doc_id")
            final = np.flatnonzero(~asked)
            if len(final):
                a, b = np.searchsorted(doc, final, "left"), np.searchsorted(doc, final, "right")
                out = [_removed(whole[i], start[x:y] - offsets[i], end[x:y] - offsets[i]) for i, x, y in zip(final.tolist(), a, b, strict=True)]
                n, removed, count, sha = (list(x) for x in zip(*out, strict=True))
                yield _found(doc=key[final], twin=twin[final], doc_id=ids.take(pa.array(final)), n_bytes=n, n_removed=removed, n_spans=count, kept_sha256=sha)
            again = np.flatnonzero(asked)
            if len(again):
                lists = [_lists(d, x - offsets[d], y - offsets[d], len(key)).take(pa.array(again)) for d, x, y in ((doc, start, end), (owner, first, last))]
                yield _found(doc=key[again], twin=twin[again], doc_id=ids.take(pa.array(again)), text=[whole[i] for i in again], settled=lists[0], asked=lists[1])

    return run


def _removed(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str]:
    """n_bytes, n_removed, n_spans, kept_sha256."""
    start, end = joined(start, end)
    kept, at = hashlib.sha256(), 0
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        kept.update(text[at:s])
        at = e
    kept.update(text[at:])
    return len(text), int((end - start).sum()), len(start), kept.hexdigest()


def _finish(length: int):
    """From a document's settled intervals, the windows it asked for and those of them that are alone, its final row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            spans = []
            for c in ("settled", "asked"):
                n, items = flat(part.column(c))
                spans.append((np.r_[0, np.cumsum(n)], items.field("start").to_numpy().astype(np.int64), items.field("end").to_numpy().astype(np.int64)))
            n, alone = flat(part.column("alone"))
            at, alone = np.r_[0, np.cumsum(n)], alone.to_numpy().astype(np.int64)
            out = []
            for i, text in enumerate(texts(part.column("text"))):
                (a, start, end), (b, low, high) = spans
                asked = ranges(low[b[i] : b[i + 1]], high[b[i] : b[i + 1]])
                hit = np.setdiff1d(asked, alone[at[i] : at[i + 1]], assume_unique=True)
                out.append(_removed(text, np.r_[start[a[i] : a[i + 1]], hit], np.r_[end[a[i] : a[i + 1]], hit + length]))
            n, removed, count, sha = (list(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in any row, this one included.
    Texts are UTF-8, null is empty; matches end with their text. Rows that repeat doc_id are documents like others; rows
    that are equal in doc_id and text are each other's copies. Other columns are not read, so their names can't clash. A text
    is one piece of work and takes about 100 times its size while it is looked at, so one of more than 10 MB or so
    wants executors with more than 1 GB for each Python worker.
    """
    spark = docs.sparkSession
    d = identified(docs)
    bounds, even = splitters(d, length)
    shared = spark.sparkContext.broadcast(bounds)
    suffixes = d.select("doc", "twin", "text").mapInArrow(_suffixes(length, shared), SUFFIX + ", bucket int")
    if even > 1:  # more buckets than the driver's sample can tell apart: ranges first, each cut by its own rows
        suffixes = suffixes.repartitionById(bounds.buckets, "bucket").mapInArrow(_finer(even), SUFFIX + ", bucket int")
    notes, buckets = neighbours(suffixes, bounds.buckets * even)
    notes = notes.groupBy("doc", "twin").agg(F.collect_set(F.struct("pos", "settled", "shared")).alias("notes"))
    found = stored(d.join(notes, ["doc", "twin"], "left").mapInArrow(_windows(length), FOUND), "suffix-windows")
    finished(buckets)
    # Counts and least places are summed up in the tasks that read the windows, so a hot window is a row of each task.
    place = F.shiftleft(F.col("twin").cast("long"), 32).bitwiseOR(F.col("start").cast("long"))
    halves = []
    for k in range(2):  # one half of the digests after the other, so that only one's shuffle is on disk at a time
        counted = found.where(f"hash is not null and hash & 1 = {k}").groupBy("hash", "more").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min(place).alias("place"))
        half = counted.where("n = 1").select("doc", F.shiftright("place", 32).cast("int").alias("twin"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start"))
        halves.append(stored(half, "windows-alone"))
    alone = stored(halves[0].unionByName(halves[1]).groupBy("doc", "twin").agg(F.collect_list("start").alias("alone")), "windows-alone")
    finished(*halves)
    rest = found.where("text is not null").select("doc", "twin", "doc_id", "text", "settled", "asked").join(alone, ["doc", "twin"], "left")
    done = rest.select("doc_id", "text", "settled", "asked", "alone").mapInArrow(_finish(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return found.where("kept_sha256 is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(done)
