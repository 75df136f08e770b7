"""The Jaccard join, spelling variants and whitening against plain versions."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import ngramjoin, spelling, whitening
from recollect.llm.queries import queries




def _rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def _joined(df):
    return _rows(df, "doc_id", "n_shingles", "component_id")


def test_jaccard_join_of_the_corpus(spark, corpus):
    got = _joined(queries()["op11_ngram_jaccard_join"](spark, "/root/testdata/sf0.001"))
    assert got == sorted(brute.jaccard_join(corpus), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_join_near_the_limit(frame, seed):
    """Groups of texts at about the limit, a hot group, shared passages and tiny chunks: chains of links and buckets in many pieces."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice((4, 6, 12, 40, 80)))]
        for _ in range(rng.choice((1, 2, 5, 30))):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            if rng.random() < 0.3:
                w = w + passage[: rng.randrange(40)]
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, " ".join(passage[i % 7 : 30 + i % 5])) for i in range(40)]
    rng.shuffle(rows)
    got = _joined(ngramjoin.ngram_jaccard_join(frame(rows), chunk=4, counted=64))
    assert got == sorted(brute.jaccard_join(rows), key=repr)
    assert len({c for _, _, c in got}) < len(rows)


def test_jaccard_join_odd_rows(frame, odd):
    rows = [*odd, *odd[:6], (2, "one two three four five six seven eight nine TEN"), (None, None)]
    assert _joined(ngramjoin.ngram_jaccard_join(frame(rows))) == sorted(brute.jaccard_join(rows), key=repr)
    assert ngramjoin.ngram_jaccard_join(frame([])).count() == 0
    assert {c for _, _, c in _joined(ngramjoin.ngram_jaccard_join(frame([(1, ""), (2, None), (3, " ")])))} == {1, 2, 3}


def test_jaccard_join_long_text(frame):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(2, long), (1, long + " end"), (3, "w1 w2 w3 w4 w5")]
    assert _joined(ngramjoin.ngram_jaccard_join(frame(rows))) == [(1, 399_997, 1), (2, 399_996, 1), (3, 1, 3)]


def test_prefixes_meet():
    """Any two sets that link share a token among the first ones of every order."""
    rng = np.random.default_rng(3)
    df = rng.integers(2, 9, 400)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = rng.choice(400, n, replace=False)
        y = np.union1d(x[: n - int(rng.integers(0, n // 5 + 1))], rng.choice(400, int(rng.integers(0, n // 6 + 1))))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        for k in range(ngramjoin.ORDERS):
            first = [t[np.lexsort((ngramjoin.permuted(t.astype(np.uint64), k), df[t]))][: ngramjoin.prefix_length(np.array([len(t)]))[0]] for t in (x, y)]
            assert len(np.intersect1d(*first))


SPELLED = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_of_the_corpus(spark, corpus):
    got = _rows(queries()["op12_spelling_variants"](spark, "/root/testdata/sf0.001"), *SPELLED)
    assert got == sorted(brute.spelling(corpus), key=repr)


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_spelling_edits_everywhere(frame, monkeypatch, chunk):
    """Edits at every place of words of every length, chains of forms, ties, words that hold others, accents; small pieces and batches."""
    monkeypatch.setattr(spelling, "TOGETHER", 50)
    rng = random.Random(chunk)
    words = set()
    for base in ("abcdefg", "abcdefgh", "aaaaaaaa", "ababababab", "straßenbahnen", "ÀÉîõüÿñç", "internationalization"):
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice((1, 1, 2))):
                i = rng.randrange(len(w))
                w[i : i + rng.choice((0, 1, 1))] = rng.choice(["", "a", "b", "é", "zz"[:1]])
            words.add("".join(w))
    rows = [(i, " ".join([w] * rng.choice((1, 2, 2, 20, 21, 300)))) for i, w in enumerate(sorted(words))]
    got = _rows(spelling.spelling_variants(frame(rows), chunk), *SPELLED)
    assert got == sorted(brute.spelling(rows), key=repr)
    assert any(f for _, f, *_ in got) and any(r != f and f for _, f, r, *_ in got)


def test_spelling_odd_rows(frame, odd):
    rows = [*odd, *odd, (None, "Nullable nullable nullables Nullables"), (77, "x" * 70_000 + " " + "x" * 70_000), (78, "x" * 70_001 + "\n" + "X" * 70_001)]
    got = _rows(spelling.spelling_variants(frame(rows)), *SPELLED)
    assert got == sorted(brute.spelling(rows), key=repr)
    assert spelling.spelling_variants(frame([])).count() == 0
    assert spelling.spelling_variants(frame([(1, None), (2, "short words")])).count() == 0


def _embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n bigint, component string")


def _plain(rows, most=16):
    """n, deviations, and whitened values and shares by a plain eigenvalue routine."""
    ok = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(np.float32(c)) for c in v)]
    x = {i: np.floor(64 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000 for i, v in ok}
    points = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, s = len(points), points.sum(0)
    c = points - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, {i: int(((n * v - s) ** 2).sum()) for i, v in x.items()}, {i: (v - s / n) @ u / np.sqrt(np.maximum(e, 1e-300)) for i, v in x.items()}, e / np.trace(c.T @ c / n)


def _holds(got, rows, k):
    n, deviation, white, explained = _plain(rows)
    assert {(r["vec_id"], r["component"]) for r in got} == {(i, j + 1) for i in deviation for j in range(k)}
    sign = {}
    for r in got:
        j = r["component"] - 1
        plain = white[r["vec_id"]][j]
        if abs(plain) > 1e-6:
            sign.setdefault(j, np.sign(plain * r["whitened"]))
        assert abs(plain * sign.get(j, 1) - r["whitened"]) < 1e-8
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert abs(r["explained"] / explained[j] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    _holds(queries()["op13_whitening"](spark, "/root/testdata/sf0.001").collect(), rows, 16)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * (1, 2, 3, 4, 5)], 1, "c") for i in range(50)]
    odd = [(50, None, 1, None), (51, [], 1, "c"), (52, [1.0, None, 1.0, 1.0, 1.0], 1, "c"), (53, [1.0, float("nan")] + [1.0] * 3, 1, "c"), (54, [float("inf")] * 5, 1, "c"), (55, [float("-inf")] * 5, None, "c")]
    twin = [(60, rows[3][1], 1, "c"), (61, rows[3][1], 1, "c")]
    _holds(whitening.whitening(_embeddings(spark, rows + odd + twin).repartition(7)).collect(), rows + odd + twin, 5)
    other = whitening.whitening(_embeddings(spark, rows + [(70, [1.0, 2.0], 1, "c")])).select("vec_id").distinct().count()
    assert other == len(rows)
    null = whitening.whitening(_embeddings(spark, rows + [(None, rows[0][1], 1, "c")]))
    assert null.where(F.col("vec_id").isNull()).count() == 5
    for none in ([], odd, [(1, [1.0, 2.0], 1, "c"), (2, [1.0, 2.0], 1, "c")]):
        assert whitening.whitening(_embeddings(spark, none)).count() == 0
    far = whitening.whitening(_embeddings(spark, [(1, [3e38, 0.0], 1, "c"), (2, [-3e38, 1.0], 1, "c"), (3, [0.0, 5.0], 1, "c")])).collect()
    assert {r["deviation"] for r in far if r["vec_id"] != 3} == {None} and max(r["identity_error"] for r in far) < 1e-4


@pytest.mark.parametrize("kind", ["gauss", "graded", "rising", "equal", "clusters", "few", "narrow", "zero", "split"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = {
        "gauss": rng.standard_normal((200, 30)),
        "graded": rng.standard_normal((200, 30)) * np.logspace(0, -7, 30),
        "rising": rng.standard_normal((200, 30)) * np.logspace(-7, 0, 30),
        "equal": np.eye(30) * 3,
        "clusters": np.diag(np.r_[np.full(8, 5.0), 5 + 1e-9 * np.arange(6), np.linspace(1, 2, 16)]) @ turn,
        "few": rng.standard_normal((7, 30)),
        "narrow": rng.standard_normal((50, 2)),
        "zero": np.zeros((5, 4)),
        "split": np.kron(np.eye(10), np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]])),
    }[kind]
    values, z = whitening.directions(whitening.triangle(a), 16)
    plain = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(plain[0], 1e-300)
    assert np.abs(values[: len(plain)] - plain).max() <= 1e-13 * top
    k = z.shape[1]
    assert k == min(16, int((plain > 1e-20 * top).sum()) if plain[0] else 0)
    assert np.abs(z.T @ z - np.eye(k)).max(initial=0) < 1e-11
    assert np.abs((a @ z).T @ (a @ z) - np.diag(values[:k])).max(initial=0) < 1e-11 * top


def test_small_singular_values_are_accurate():
    """A graded bidiagonal matrix: each value to a relative 1e-13, the smallest too."""
    d, e = np.logspace(0, -30, 12), np.logspace(0, -30, 12)[1:] * 0.5
    from fractions import Fraction

    values = whitening.dqds(d, e)
    exact = Fraction(1)
    for x in d:
        exact *= Fraction(float(x)) ** 2
    found = Fraction(1)
    for x in values:
        found *= Fraction(float(x))
    assert abs(float(found / exact) - 1) < 1e-12
