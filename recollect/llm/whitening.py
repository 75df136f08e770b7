"""Embedding whitening: blockwise QR, bidiagonal form, singular values by dqds, directions by twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it, either way, count as this: x stays far from the ends of a long.
MOST = 2.0**40
COMPONENTS = 16
#: Numbers of a block that is reduced at once.
BLOCK = 1 << 20
#: R factors that one task puts together in a step of the tree.
FAN = 32
EPS = np.finfo(np.float64).eps


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (longs) of rows with a usable vector: not null or empty, every entry a finite number."""
    e = F.col("embedding")
    usable = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    clipped = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE).cast("double")))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", F.transform(e, lambda c: clipped(c).cast("bigint") + SHIFT).alias("x"))


def matrix(col: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of rows, as square as the rows are wide."""
    r = np.linalg.qr(rows, mode="r")
    out = np.zeros((rows.shape[1],) * 2)
    out[: len(r)] = r
    return out


def _reduced(mean: np.ndarray):
    """R of each partition's centred rows: block after block under the R so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        step = max(len(mean), BLOCK // len(mean))
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = matrix(batch.column("x").slice(at, step)) - mean
                r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """R of the R factors of a partition, one after the other."""
    out = None
    for batch in batches:
        for i in range(len(batch)):
            flat = batch.column("r")[i].values.to_numpy()
            r = flat.reshape(-1, int(round(len(flat) ** 0.5)))
            out = r if out is None else triangle(np.vstack([out, r]))
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["r"])


def qr(points: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of all centred rows x: one factor of a partition, then a tree of FAN factors a task. The driver gets the last one."""
    factors = stored(points.select("x").mapInArrow(_reduced(mean), "r array<double>"), "factors")
    n = factors.count()
    while n > 1:
        n = -(-n // FAN)
        new = stored(factors.repartition(n).mapInArrow(_joined, "r array<double>"), "factors")
        finished(factors)
        factors, n = new, new.count()
    r = np.array(factors.first()["r"])
    finished(factors)
    return r.reshape(len(mean), -1)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of the bidiagonal form B = U' r V, by Householder reflections from both sides."""
    b, n = r.copy(), r.shape[1]
    v = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            return None
        w = x / size
        w[0] += 1.0 if w[0] >= 0 else -1.0
        return w / np.linalg.norm(w)

    for k in range(n):
        w = mirror(b[k:, k])
        if w is not None:
            b[k:, k:] -= 2 * np.outer(w, w @ b[k:, k:])
        if k < n - 2:
            w = mirror(b[k, k + 1 :])
            if w is not None:
                b[k:, k + 1 :] -= 2 * np.outer(b[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(b).copy(), np.diag(b, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform; and the least of its auxiliary values, below 0 if the shift was too large."""
    n = len(q)
    d = q[0] - shift
    low = d
    nq, ne = [0.0] * n, [0.0] * (n - 1)
    for i in range(n - 1):
        nq[i] = d + e[i]
        if nq[i] <= 0:
            return nq, ne, -1.0
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
        low = min(low, d)
    nq[n - 1] = d
    return nq, ne, low


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by differential quotient-difference with shifts.

    Products and quotients of positive numbers only: every value, small ones too, comes out to a few units of its last place.
    A shift that is too large shows as a negative number and is halved, at last left out.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    todo = [(((diagonal / scale) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    out: list[float] = []
    while todo:
        q, e, moved = todo.pop()
        shift = 0.0
        for _ in range(60 * len(q) + 100):
            n = len(q)
            if n == 1:
                out.append(q[0] + moved)
                break
            # Where a coupling is nothing against its neighbours the matrix falls apart.
            gone = [i for i in range(n - 1) if e[i] <= (EPS / 4) ** 2 * max(q[i], q[i + 1], 1e-300) or e[i] <= EPS**2 * (moved + min(q[i], q[i + 1]))]
            if gone:
                at = gone[-1]
                todo.append((q[: at + 1], e[:at], moved))
                todo.append((q[at + 1 :], e[at + 1 :], moved))
                break
            if n > 1 and q[0] < q[-1]:  # graded the wrong way: turn it round
                q, e = _turned(q, e)
            nq, ne, low = _step(q, e, shift)
            while low < 0:
                shift = shift / 2 if shift > 1e-3 * min(q) else 0.0
                nq, ne, low = _step(q, e, shift)
            q, e, moved = nq, ne, moved + shift
            # The next shift: what the last two rows alone suggest, below the least auxiliary value.
            shift = max(0.0, min(low, _corner(q, e)) * (1 - 1e-2) - 2 * e[-1]) if e[-1] < 0.25 * q[-1] else max(0.0, 0.25 * min(low, q[-1] - e[-1] if q[-1] > e[-1] else 0.0))
        else:
            raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(out))[::-1] * scale**2


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The bidiagonal matrix seen from its other end: the same singular values."""
    return q[::-1], e[::-1]


def _corner(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows."""
    a, b, c = q[-2] + e[-2] if len(e) > 1 else q[-2], q[-1] + e[-1], q[-2] * e[-1]
    mid, half = (a + b) / 2, ((a - b) ** 2 / 4 + c) ** 0.5
    return max(0.0, (a * b - c) / (mid + half)) if mid + half > 0 else 0.0


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for one of its eigenvalues: the factorisations from the top and from the bottom of
    B'B - value meet in the row where the remainder is least, and the vector is read off from there, both ways."""
    n = len(diagonal)
    main = diagonal**2 + np.r_[0.0, above**2] - value
    side = diagonal[:-1] * above
    tiny = EPS**2 * float((diagonal**2).max())
    down, up = main.copy(), main.copy()
    some = lambda x: x if abs(x) > tiny else tiny
    for i in range(1, n):
        down[i] -= side[i - 1] ** 2 / some(down[i - 1])
    for i in range(n - 2, -1, -1):
        up[i] -= side[i] ** 2 / some(up[i + 1])
    middle = int(np.argmin(np.abs(down + up - main)))
    z = np.zeros(n)
    z[middle] = 1.0
    for i in range(middle - 1, -1, -1):
        z[i] = -side[i] * z[i + 1] / some(down[i])
    for i in range(middle + 1, n):
        z[i] = -side[i - 1] * z[i - 1] / some(up[i])
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of r'r, falling, and the unit eigenvectors (columns) of the first ones above rounding error.

    Vectors of values close to each other are made orthogonal, and turned within their common space to the eigenvectors
    of r'r in it.
    """
    diagonal, above, v = bidiagonal(r)
    values = dqds(diagonal, above)
    kept = int((values[:most] > values[:1].max(initial=0.0) * (len(values) * EPS) ** 2).sum())
    if not kept:
        return values, np.zeros((len(values), 0))
    z = np.stack([twisted(diagonal, above, x) for x in values[:kept]], 1)
    b = np.diag(diagonal) + np.diag(above, 1)
    first = 0
    while first < kept:
        last = first + 1
        while last < kept and values[last - 1] - values[last] < 1e-3 * values[0]:
            last += 1
        if last - first > 1:
            own = z[:, first:last]
            for k in range(own.shape[1]):  # equal values give one vector twice: what is left of it starts from elsewhere
                for attempt in range(3):
                    x = own[:, k] if attempt == 0 else np.random.default_rng((attempt, k)).standard_normal(len(own))
                    for _ in range(2):
                        x = x - z[:, :first] @ (z[:, :first].T @ x) - own[:, :k] @ (own[:, :k].T @ x)
                    if attempt:
                        x = _inverse(diagonal, above, values[first + k], x)
                        for _ in range(2):
                            x = x - z[:, :first] @ (z[:, :first].T @ x) - own[:, :k] @ (own[:, :k].T @ x)
                    if np.linalg.norm(x) > (1e-6 if attempt == 0 else 0):
                        break
                own[:, k] = x / np.linalg.norm(x)
            small = b @ own
            turn = np.linalg.eigh(small.T @ small)[1][:, ::-1]
            z[:, first:last] = own @ turn
        first = last
    return values, v @ z


def _inverse(diagonal: np.ndarray, above: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """x made to point to the eigenvectors of B'B next to the value: two steps of inverse iteration."""
    main = diagonal**2 + np.r_[0.0, above**2]
    side = diagonal[:-1] * above
    t = np.diag(main - value * (1 + 4 * EPS)) + np.diag(side, 1) + np.diag(side, -1)
    t += np.eye(len(main)) * EPS * max(float(main.max()), 1e-300)
    for _ in range(2):
        x = np.linalg.solve(t, x)
        x = x / np.linalg.norm(x)
    return x


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: n different vectors x, their sums, and the components' eigenvalues, shares and directions."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum) ** 2, exactly; null if it is no long."""
        top = int(np.abs(x).max(initial=0))
        most = max(self.n * top + max(map(abs, self.sums)), 1)
        if most**2 * x.shape[1] < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        if most < 2**63:  # differences fit a long, their squares may not
            far = np.abs(self.n * x - np.array(self.sums, np.int64))
            if int(far.max()) ** 2 * x.shape[1] < 2**63:
                return (far**2).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in exact]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many points a partition has and the sum of each dimension."""
    n, sums = 0, None
    for batch in batches:
        for at in range(0, len(batch), 4096):  # 4,096 entries of 2 ** 47 at most: no sum leaves a long
            own = [int(s) for s in matrix(batch.column("x").slice(at, 4096)).sum(0)]
            sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        n += len(batch)
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array(sums, pa.decimal128(38, 0))], ["dim", "n", "s"])


def fit(points: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the different vectors x of points (a stored table of one length of vectors); None if there is none."""
    own = points.select("x").mapInArrow(_sums, "dim int, n bigint, s decimal(38,0)").groupBy("dim").agg(F.sum("n"), F.sum("s"))
    own = sorted(own.collect())  # d rows, whatever the number of points
    if not own:
        return None
    n, sums = int(own[0][1]), [int(r[2]) for r in own]
    mean = np.array([s / n for s in sums])
    values, vectors = directions(qr(points, mean), most)
    kept = vectors.shape[1]
    total = float(values.sum())
    return Whitening(n, sums, values[:kept] / n, values[:kept] / total if total else values[:kept], vectors)


def _products(w: Whitening):
    """Sums of products of the whitened components over a partition, centred by their means before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w.values),) * 2)
        for batch in batches:
            if len(batch):
                y = w.whitened(matrix(batch.column("x")))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    return run


def identity_error(points: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened points' covariance minus the identity. x - S/n has mean 0, so the whitened ones have."""
    cells = points.select("x").mapInArrow(_products(w), "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    k = len(w.values)
    found = np.zeros(k * k)
    for r in cells:
        found[r["cell"]] = r["v"]
    return float(np.abs(found.reshape(k, k) / w.n - np.eye(k)).max())


def _rows(w: Whitening, error: float):
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column("x"))
                rows = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(rows), w.n)),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(rows)),
                        pa.array(w.whitened(x).ravel()),
                        pa.array(np.tile(w.explained, len(part))),
                        pa.array(np.full(len(rows), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitening(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and each of the first components.

    Rows whose vector is null or empty or has an entry that is null or no finite number give no row, and neither do rows
    whose vector has another length than most have (of equally frequent lengths the longest counts). Equal vectors are one in
    the fit; rows that repeat give rows each, a null vec_id stays null. Components are fewer than most where the vectors
    span fewer dimensions: one vector alone, or equal ones, and an empty table give no row. A vector has one
    row of its table, so its length is bounded by what a row holds. A deviation that is no long is null.
    """
    spark = embeddings.sparkSession
    x = stored(integers(embeddings), "integers")
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], SCHEMA)
    if not sizes:
        return empty
    x = x.where(F.size("x") == sizes[0]["d"])
    points = stored(x.select("x").distinct(), "points")
    w = fit(points, most)
    if w is None or not len(w.values):
        finished(points)
        return empty
    error = identity_error(points, w)
    finished(points)
    return x.mapInArrow(_rows(w, error), SCHEMA)
