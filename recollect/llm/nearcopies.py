"""Near copies by five-word Jaccard: candidates by op1's fingerprint search and by banded min-hashes, verified on the sets, then
connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import finished, stored, text_slices, texts
from .components import components
from .ngramjoin import leader_pieces, rest_pieces
from .repeats import mix
from .shingles import shingles
from .simhash import _forest, fingerprint, near_links

#: Jaccard of near copies, as a fraction.
ALIKE = (4, 5)
#: Sets of Jaccard J share a band with probability 1 - (1 - J ** 4) ** 20: 0.99997 at 0.8.
BANDS, DEPTH = 20, 4
#: Texts compared with each other in one piece of work; larger buckets are dealt out as pairs of chunks.
CHUNK = 512
#: Columns of a dense table of texts and shingles.
COLUMNS = 4096


def bands(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket names for each set; none may be empty."""
    rng = np.random.default_rng(11)
    out = np.zeros((len(at) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        name = np.full(len(at) - 1, b, np.uint64)
        for flip, odd in rng.integers(0, 2**64, (DEPTH, 2), np.uint64, endpoint=False):
            name = mix(name ^ np.minimum.reduceat((sets ^ flip) * (odd | np.uint64(1)), at[:-1]))
        out[:, b] = name
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        bodies = texts(part.column("text"))
        sets, at = shingles(bodies)
        prints = np.array([fingerprint(t) for t in bodies], np.uint64)
        keys = np.array([xxhash.xxh3_64_intdigest(sets[a:b].tobytes()) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
        some = np.diff(at) > 0
        offsets = np.r_[0, np.cumsum(some * BANDS)].astype(np.int32)
        own = bands(sets, np.r_[at[:-1][some], at[-1]]) if some.any() else np.zeros(0, np.uint64)
        names = pa.ListArray.from_arrays(pa.array(offsets), pa.array(own.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys.view(np.int64)), names, pa.array(prints.view(np.int64))], [*part.schema.names, "key", "bands", "fp"])


def _alike(bodies: list[bytes], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts, one of each side (or of side 0 where it is the only one), whose sets are alike."""
    sets, at = shingles(bodies)
    size, doc = np.diff(at), np.repeat(np.arange(len(bodies)), np.diff(at))
    _, column, held = np.unique(sets, return_inverse=True, return_counts=True)
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]  # shingles that one text alone has meet no other
    doc, column = doc[order], column[order]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = b if len(b) else a
    both = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        here = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        table = np.zeros((len(bodies), int(column[here][-1]) - low + 1), np.float32)
        table[doc[here], column[here] - low] = 1
        both += (table[a] @ table[b].T).astype(np.int64)
    part, whole = ALIKE
    i, j = np.nonzero(both * (part + whole) >= part * (size[a][:, None] + size[b][None, :]))
    return a[i], b[j]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, x, y, side, key, text), a bucket's chunk pair all in one partition and in order, a link
    (src, dst) from each text to the first that it reaches within its chunk pair."""
    rest = None
    for batch in _ended(batches):
        rows = [x for x in (rest, None if batch is None else pa.Table.from_batches([batch])) if x is not None]
        if not rows:
            continue
        t = pa.concat_tables(rows)
        place = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")], 1)
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)]) if len(t) else np.zeros(0, int)
        ends = np.r_[starts[1:], len(t)]
        rest = None
        if batch is not None:  # the last group may go on in the next batch
            rest = t.slice(starts[-1]) if len(starts) else None
            starts, ends = starts[:-1], ends[:-1]
        side, key = t.column("side").to_numpy(), t.column("key").to_numpy()
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            bodies = [(x or "").encode() for x in t.column("text").slice(s, e - s).to_pylist()]
            root = _forest(e - s, *_alike(bodies, side[s:e]))
            moved = np.flatnonzero(root != np.arange(e - s))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(key[s:e][moved]), pa.array(key[s:e][root[moved]])], ["src", "dst"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _compared(pieces: DataFrame, groups: DataFrame, d: DataFrame, name: str) -> DataFrame:
    """Links of pieces (bucket, x, y, side, root, key): each piece gets its texts and is compared in one go."""
    p = stored(pieces.join(groups.select("key", "row"), "key").drop("root"), f"{name}-pieces")
    b = p.hint("merge").join(d.select("row", "text"), "row")  # the same plan at every size
    b = b.select("bucket", "x", "y", "side", "key", "text").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side", "key")
    links = stored(b.mapInArrow(_links, "src bigint, dst bigint").distinct(), f"{name}-links")
    finished(p)
    return links


def print_classes(d: DataFrame) -> DataFrame:
    """token, key of the sets (key; not that of texts without words) whose fingerprints (fp) op1's search links, directly or by
    way of others: a token for each of its components of several sets."""
    prints = d.where("key <> 0").select("fp", "key").distinct()
    links = near_links(prints.select("fp").distinct())
    # A fingerprint that has no link may be that of several sets.
    roots = prints.join(components(links), prints.fp == F.col("node"), "left").select("key", F.coalesce("root", "fp").alias("root"))
    out = stored(roots.select(F.xxhash64(F.lit("fp"), "root").alias("token"), "key").distinct(), "print-classes")
    finished(links)
    return out


def classes(docs: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with a number (doc_id, text, row, key, rest: their other columns), stored, and key, root, owner: the
    class of each set and the smallest doc_id in it.

    Links join texts whose sets of five-word shingles have a Jaccard of 0.8 or more; texts without words are alike. Equal
    sets are compared once. Sets meet in the components of op1's fingerprints (at most 3 bits apart, by pivot tables), and for
    those that so few bits do not show, in the buckets of their bands. In each bucket the first set is compared with all
    others; then sets of one bucket that are in different components still, with each other.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*other) if other else F.struct(F.lit(None).cast("int").alias("none"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"), F.struct("text", rest.alias("other")).alias("rest"))
    d = d.withColumn("rest", F.struct(F.col("rest.text").isNull().alias("null"), F.col("rest.other").alias("other")))
    schema = StructType([*d.schema.fields, StructField("key", LongType()), StructField("bands", ArrayType(LongType())), StructField("fp", LongType())])
    d = stored(d.mapInArrow(_named, schema), "shingled")
    groups = d.groupBy("key").agg(F.min("doc_id").alias("owner"), F.min("row").alias("row"), F.first("bands").alias("bands"))
    groups = stored(groups, "sets")
    prints = print_classes(d)
    index = groups.select(F.explode("bands").alias("token"), "key").unionByName(prints)
    index = stored(index.withColumn("size", F.lit(1)), "bands")
    finished(prints)
    first = _compared(leader_pieces(index, chunk), groups, d, "leader")
    roots = stored(components(first), "roots")
    pieces = rest_pieces(index, roots, chunk)
    rest = _compared(pieces, groups, d, "rest")
    finished(pieces, index)
    links = roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(rest)
    # The component of a set that has no link is its own group.
    named = groups.join(components(links), groups.key == F.col("node"), "left").select("key", "owner", F.coalesce("root", "key").alias("root"))
    owners = named.groupBy("root").agg(F.min("owner").alias("owner"))
    named = stored(named.select("key", "root").join(owners, "root"), "classes")
    finished(first, rest, roots, groups)
    return d, named


def near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, component_id for every row of docs: the smallest doc_id that links lead to. A null doc_id never names a component
    unless it has no other. See classes() for the links."""
    d, named = classes(docs, chunk)
    return d.select("doc_id", "key").join(named, "key").select("doc_id", F.col("owner").alias("component_id"))


def one_of_each(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row of each class of near copies, as it is in docs: of the smallest doc_id, of several such rows one by the
    hash of its text. A row without doc_id stays only in a class that has none with one."""
    d, named = classes(docs, chunk)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")
    kept = d.join(named.select("key", "root"), "key").groupBy("root").agg(F.min(order).alias("first"))
    whole = d.join(kept.select(F.col("first.row").alias("row")), "row", "left_semi")
    values = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("rest.null"), F.col("text"))}
    return whole.select(*[values.get(c, F.col("rest.other").getField(c)).alias(c) for c in docs.columns])
