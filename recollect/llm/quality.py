"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_bytes, text_slices

HASHED = 2048
STYLE = 8
THRESHOLD = 0.3
SLICE = 2 << 20


@dataclass(frozen=True)
class Model:
    """Labelled neighbours, at most `most_labelled` of them, whatever the size of the corpus."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: counts of hashed byte trigrams, then counts of words by style, scaled to its share of the text.

    Digits count as one symbol. Styles: upper-case letters, symbols, white space, words equal to the word before, short
    words, bytes outside ASCII, line ends, digits.
    """
    n = len(offsets) - 1
    out = np.zeros((n, HASHED + STYLE), np.float32)
    if not len(data):
        return out
    b = data.copy()
    b[(b >= 48) & (b <= 57)] = 48
    doc = np.repeat(np.arange(n), np.diff(offsets))
    if len(b) >= 3:
        x = b.astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        whole = doc[2:] == doc[:-2]
        out[:, :HASHED] = np.bincount(doc[:-2][whole] * HASHED + h[whole], minlength=n * HASHED).reshape(n, HASHED)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~space & np.r_[True, space[:-1] | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(start)
    sums = np.r_[0, np.cumsum(data, dtype=np.int64)]
    end = np.flatnonzero(~space & np.r_[space[1:] | (doc[1:] != doc[:-1]), True]) + 1
    length, total = end - at, sums[end] - sums[at]
    again = np.r_[False, (length[1:] == length[:-1]) & (total[1:] == total[:-1]) & (data[at[1:]] == data[at[:-1]])] & np.r_[False, doc[at[1:]] == doc[at[:-1]]]
    upper = (data >= 65) & (data <= 90)
    symbol = (data > 32) & (data < 127) & ~upper & ~((data >= 97) & (data <= 122)) & ~((data >= 48) & (data <= 57)) & (data != 44) & (data != 46)
    size = np.maximum(1, np.diff(offsets))
    words = np.maximum(1, np.bincount(doc[at], minlength=n))
    for j, (where, per) in enumerate(((upper, size), (symbol, size), (space, size), (data >= 128, size), (data == 10, size), ((data >= 48) & (data <= 57), size))):
        out[:, HASHED + j] = np.bincount(doc[where], minlength=n) / per
    out[:, HASHED + 6] = np.bincount(doc[at[again]], minlength=n) / words
    out[:, HASHED + 7] = np.bincount(doc[at[length <= 2]], minlength=n) / words
    return out


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times inverse document frequency at length 1, and beside them the styles."""
    x = np.log1p(raw[:, :HASHED]) * idf
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    style = np.sqrt(raw[:, HASHED:])
    return np.hstack([x, style]).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, SLICE):
        rows = features(*text_bytes(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "raw"])


def learn(raw: np.ndarray, label: np.ndarray, dims: int, k: int) -> Model:
    """The model of labelled feature rows."""
    if not len(raw):
        return Model(np.ones(HASHED, np.float32), np.zeros((HASHED + STYLE, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, k)
    idf = (np.log((1 + len(raw)) / (1 + (raw[:, :HASHED] > 0).sum(0))) + 1).astype(np.float32)
    x = weighted(raw, idf)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :dims]
    # Signs of eigenvectors are free: fix them, so that reruns agree.
    axes = (axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)).astype(np.float32)
    vectors = x @ axes
    norms = np.linalg.norm(vectors, axis=1)
    keep = norms > 1e-9
    return Model(idf, axes, vectors[keep] / norms[keep, None], label[keep], float(label.mean()), k)


def _fit(most_labelled: int, dims: int, k: int):
    """From all labelled rows of the sample, which are one partition, the pickled model. Rows that repeat a doc_id are
    kept by their features' order, so no more than most_labelled are ever held beside one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            held += [(xxhash.xxh3_64_intdigest(str(d)), d, raw, label) for d, raw, label in zip(ids, b.column("raw").to_pylist(), b.column("label").to_pylist(), strict=True)]
            held.sort()
            del held[most_labelled:]
        raw = np.frombuffer(b"".join(r[2] for r in held), np.float32).reshape(len(held), HASHED + STYLE)
        label = np.array([r[3] for r in held], np.float64)
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(raw, label, dims, k))], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, dims: int = 48, k: int = 25) -> Model:
    """Learns from at most most_labelled rows, those whose doc_id hashes lowest, none of them held out.

    labels: doc_id, quality. One task learns from the sample's feature vectors, which are of a fixed size; only the
    model (about 1 MB) comes to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    ids = docs.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    one = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = one.select("doc_id", "text", "label").mapInArrow(_features, "doc_id bigint, label int, raw binary").repartition(1)
    found = rows.mapInArrow(_fit(most_labelled, dims, k), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else learn(np.zeros((0, HASHED + STYLE), np.float32), np.zeros(0), dims, k)


def score(raw: np.ndarray, model: Model, power: float = 20.0) -> np.ndarray:
    """Share of label 1 among the k nearest labelled vectors, each vote weighted by its cosine to a power."""
    out = np.full(len(raw), model.prior)
    if not len(model.labels) or not len(raw):
        return out
    v = weighted(raw, model.idf) @ model.axes
    norm = np.linalg.norm(v, axis=1)
    ok = (norm > 1e-9) & (raw[:, :HASHED].sum(1) > 0)
    k = min(model.k, len(model.labels))
    for lo in range(0, len(raw), 512):
        rows = np.flatnonzero(ok[lo : lo + 512]) + lo
        if not len(rows):
            continue
        cos = (v[rows] / norm[rows, None]) @ model.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6) ** power
        out[rows] = (w * model.labels[near]).sum(1) / w.sum(1)
    return np.clip(out, 0, 1)


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            s = np.round(score(features(*text_bytes(part.column("text"))), model.value), 6)
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), part.column("text"), pa.array(s)], [*rest, "text", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    score is the labelled neighbours' share of label 1. Texts without three bytes, null ones too, score the share of
    label 1 among all learned labels. Without any labels every score is 0.5. Rows that repeat a doc_id are
    scored each by its text; a null doc_id is not held out. Labels that repeat a doc_id count once, as the largest. Where
    neighbours are equally near at the k-th place, a partial sort of the sample, whose order is fixed, decides. A long text is one row of
    counts of a fixed size. Columns but doc_id and text are not read, so their names can't clash.
    """
    out = _scored(docs.select("doc_id", "text"), labels, most_labelled)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most_labelled))
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != "text"] + ["text string", "score double"])
    return docs.mapInArrow(_scores(model), schema)


def keep_good(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias("_rest"))
    out = _scored(packed, labels, most_labelled).where(F.col("score") >= threshold)
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
