"""SimHash near-dedup: exact Hamming search with pivot distance tables, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, stored, text_slices, texts
from .components import components

SHINGLE = 3
RADIUS = 3
#: Bit ranges of the fingerprint. Fingerprints that differ in 3 bits or fewer agree on 3 of the 6 blocks at least.
BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
AGREE = 3
#: Fingerprints compared with each other in one piece of work; larger buckets are dealt out as pairs of chunks.
CHUNK = 1024


def pivots(n: int = 16, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, drawn once from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64, endpoint=False)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    if len(words) <= k:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    h = np.fromiter(map(_hash, grams), np.uint64, len(grams))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _hash(gram: bytes) -> int:
    return xxhash.xxh64_intdigest(gram, 42)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        prints = np.array([fingerprint(t) for t in texts(part.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def distance_table(fp: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to the pivots, a row for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ pivot).astype(np.int16)


def _within(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all fingerprints of a and b, with their distance tables, at most radius bits apart.

    By the triangle inequality no coordinate of a pair differs by more than the pair's distance, so a pair goes if
    its largest coordinate difference is above the radius. Sorting b by the first coordinate leaves a range for each of
    a; the survivors of all coordinates are verified on the fingerprints.
    """
    order = np.argsort(tb[:, 0], kind="stable")
    first = tb[order, 0]
    low, high = np.searchsorted(first, ta[:, 0] - radius, "left"), np.searchsorted(first, ta[:, 0] + radius, "right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    for k in range(1, ta.shape[1]):
        keep = np.abs(ta[i, k] - tb[j, k]) <= radius
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(a[i] ^ b[j]) <= radius
    return i[keep], j[keep]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that links (i, j) lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(radius: int, pivot: np.ndarray):
    """From rows (bucket, x, y, side, fp), a bucket's chunk pair all in one partition and in order, a link (src, dst)
    from each fingerprint to the smallest that it reaches within its chunk pair."""

    def work(side: np.ndarray, fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b if len(b) else a
        i, j = _within(fp[a], fp[b], table[a], table[b], radius)
        root = _forest(len(fp), a[i], b[j])
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return fp[moved], fp[root[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in (*batches, None):
            rows = [x for x in (rest, None if batch is None else pa.Table.from_batches([batch])) if x is not None]
            if not rows:
                continue
            t = pa.concat_tables(rows)
            key = np.stack([t.column(c).to_numpy() for c in ("bucket", "x", "y")], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(t) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(t)]
            if batch is not None:  # the last group may go on in the next batch
                rest = t.slice(starts[-1]) if len(starts) else None
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = None
            side, fp = t.column("side").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            table = distance_table(fp, pivot)
            src, dst = [], []
            pair = starts[ends - starts == 2]  # all buckets of two at once
            near = pair[np.abs(table[pair] - table[pair + 1]).max(1, initial=0) <= radius]
            near = near[np.bitwise_count(fp[near] ^ fp[near + 1]) <= radius]
            src.append(fp[near])
            dst.append(fp[near + 1])
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                u, v = work(side[s:e], fp[s:e], table[s:e])
                src.append(u)
                dst.append(v)
            u, v = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """src, dst: links between different fingerprints (column fp, each once) whose components are those of all pairs at
    most radius bits apart.

    Random pivots alone part few pairs (distances to a pivot crowd around 32 bits), so buckets come first: pairs
    within 3 bits agree on at least 3 of 6 blocks, so each fingerprint is put under all 20 choices of 3 blocks, and
    those that share a key are compared by their pivot tables. A bucket of n above the chunk size is cut into
    n / chunk parts and every two parts are one piece of work, in which no more than a spanning forest is emitted.
    """
    if radius > len(BLOCKS) - AGREE:
        raise ValueError(f"the blocks hold for {len(BLOCKS) - AGREE} bits at most")
    keys = []
    for t, chosen in enumerate(combinations(BLOCKS, AGREE)):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed))))
    d = prints.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    # Written out, so that both sides of the join are plain exchanges and a hot bucket's rows can be split.
    counts = stored(d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "buckets")
    d = d.join(counts, "bucket")
    parts = F.ceil(F.col("n") / chunk)
    d = d.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")))
    # A part meets every part once: (x, y) with x <= y; the lower one is side 0, the other side 1.
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    d = d.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    d = d.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "side", "fp")
    links = stored(d.mapInArrow(_links(radius, pivots()), "src bigint, dst bigint").distinct(), "links")
    finished(counts)
    return links


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    d = stored(fingerprints(docs), "fingerprints")
    groups = d.groupBy("fp").agg(F.min("doc_id").alias("owner"))
    links = near_links(d.select("fp").distinct(), radius)
    roots = components(links)
    # The component of a fingerprint that has no link is its own group.
    named = groups.join(roots, groups.fp == roots.node, "left").select("fp", "owner", F.coalesce("root", "fp").alias("root"))
    owners = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    # Written out for the same reason: a hot fingerprint's rows.
    named = stored(named.join(owners, "root").select("fp", "component_id"), "named")
    finished(links)
    return d.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Links are at most radius differing bits; component_id is the smallest doc_id that a row's links reach. Texts
    without words, null included, have fingerprint zero and link like any other. Rows of equal doc_id are
    rows like others. A null doc_id never names a component unless it has no other. A bit that is set in exactly half
    the shingles is 0. A long text is one fingerprint in the task that has its row. Columns but doc_id and text are not
    read, so their names can't clash.
    """
    return classes(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
