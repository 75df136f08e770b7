import brute
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from recollect.llm import decontam
from recollect.llm.nearcopies import near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on what the one before kept, against plain versions where there are some."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen[name] = (docs.collect(), rows)
        if name != "mixture":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    before, after = seen["lines"]
    plain = {d: s for d, _, _, s in brute.lines([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: brute.sha(r["text"].encode()) for r in after} == plain
    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after} == {c for _, _, c in brute.simhash([(r["doc_id"], r["text"]) for r in before])}
    before, after = seen["decontaminate"]
    items = [decontam.shingles(decontam.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in before for s in items if len(s & decontam.shingles(decontam.words(r["text"]))) >= 0.8 * len(s)}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    before, after = seen["mixture"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_run(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0


@pytest.mark.parametrize("stage", [n for n, _ in C.STAGES])
def test_odd_and_empty(spark, frame, odd, stage):
    f = dict(C.STAGES)[stage]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert f(spark, frame(odd).select(columns), SF).count() <= len(odd)
    assert f(spark, frame([]).select(columns), SF).count() == 0


def near_rows():
    """Texts with substituted words, on both sides of a five-word Jaccard of 0.8, blanks, and one large group."""
    rng = np.random.default_rng(3)
    out = [(900, None), (901, " "), (902, "two words"), (903, "Two  words"), (904, "two others")]
    for k in range(90):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 500)))]
        other = list(base)
        for at in rng.choice(len(base), int(rng.integers(1, 1 + len(base) // 25)), replace=False):
            other[at] = "new"
        out += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    for k in range(60):
        base[int(rng.integers(0, 200))] = f"step{k}"
        out.append((500 + k, " ".join(base)))
    return out


def plain_components(rows):
    sets = [decontam.shingles(brute.WORD.findall((t or "").lower())) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root = [root[j] if x == root[i] else x for x in root]
    low = {}
    for (d, _), x in zip(rows, root, strict=True):
        low[x] = min(low.get(x, d), d)
    return {d: low[x] for (d, _), x in zip(rows, root, strict=True)}


def test_near_copies_by_jaccard(spark, frame):
    rows = near_rows()
    plain = plain_components(rows)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    got = C.near_dedup(spark, frame(rows).select(columns), SF).collect()
    assert {r["doc_id"] for r in got} == set(plain.values())
    assert {r["doc_id"]: r["component_id"] for r in near_copies(frame(rows), chunk=7).collect()} == plain


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_classes(rows):
    """Classes of rows, as lists of their places, whose texts are near copies."""
    sets = [decontam.shingles(brute.WORD.findall((t or "").lower())) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root = [root[j] if x == root[i] else x for x in root]
    out = {}
    for i, x in enumerate(root):
        out.setdefault(x, []).append(rows[i])
    return list(out.values())


def holds(kept, rows):
    """Whether kept is one row of each class, of the smallest doc_id in it."""
    left = list(kept)
    for c in row_classes(rows):
        best = min((d for d, _ in c if d is not None), default=None)
        mine = [r for r in left if r in c and r[0] == best]
        assert mine, c
        left.remove(mine[0])
    assert not left


def test_near_dedup_goes_by_row(spark, frame):
    x, y = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(3, x), (5, y), (5, x + " end"), (9, x)]
    got = C.near_dedup(spark, frame(rows).select(COLUMNS), SF)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(3, x), (5, y)]


def test_near_dedup_of_repeated_rows(spark, frame, odd):
    some = near_rows()[::5]
    rows = [*odd, *odd, *some, *[(d // 3, t) for d, t in some], (None, None), (None, "alone without a number " * 9)]
    got = C.near_dedup(spark, frame(rows).select(COLUMNS), SF)
    assert got.columns == COLUMNS
    holds([(r["doc_id"], r["text"]) for r in got.collect()], rows)


def test_stages_of_repeated_rows(spark, frame, odd):
    """What the other stages keep of repeated rows, ties and long texts: they decide row by row."""
    rows = [*odd, *odd, (2, "other text under a used number"), (20, "word and more " * 30_000)]
    docs = frame(rows).select(COLUMNS)
    got = [(r["doc_id"], r["text"]) for r in C.quality(spark, docs, SF).collect()]
    assert all(got.count(r) in (0, rows.count(r)) for r in rows) and set(got) <= set(rows)
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in C.lines(spark, docs, SF).collect()]
    plain = [(d, h) for d, _, _, h in brute.lines(rows) if d is not None]
    assert sorted((d, brute.sha((t or "").encode())) for d, t, _ in got if d is not None) == sorted(plain)
    assert all(n == (None if t is None else len(t)) for _, t, n in got) and len(got) == len(rows)
    assert sum(t is None for _, t, _ in got) == sum(t is None for _, t in rows)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    more = [*rows, (30, f"before {item} after"), (30, "clean"), (None, item)]
    got = [(r["doc_id"], r["text"]) for r in C.decontaminate(spark, frame(more).select(COLUMNS), SF).collect()]
    assert sorted(got, key=repr) == sorted([*rows, (30, "clean")], key=repr)
    got = C.mixture(spark, docs, SF).collect()
    sizes = [len(brute.WORD.findall(t or "")) for _, t in rows]
    assert sorted(r["size"] for r in got) == sorted(sizes)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and abs(sum(r["taken"] for r in got) - sum(sizes)) <= 1


def test_near_dedup_meets_by_fingerprints(spark, frame, monkeypatch):
    """Candidates come from op1's search, with its components: near copies are dropped without any band."""
    from recollect.llm import nearcopies as N

    rows = [r for r in near_rows() if r[1] and r[1].strip()]
    prints = dict(zip([d for d, _ in rows], [c for _, _, c in brute.simhash(rows)], strict=True))
    met = []
    real = N.print_classes

    def seen(d):
        out = real(d)
        met.extend((r["token"], r["doc_id"]) for r in out.join(d.select("doc_id", "key"), "key").collect())
        return out

    monkeypatch.setattr(N, "print_classes", seen)
    monkeypatch.setattr(N, "bands", lambda sets, at: np.arange((len(at) - 1) * N.BANDS, dtype=np.uint64).reshape(-1, N.BANDS) + np.random.default_rng().integers(0, 2**62, dtype=np.uint64))
    got = {r["doc_id"]: r["component_id"] for r in near_copies(frame(rows)).collect()}
    token = {d: t for t, d in met}
    assert all((token[a] == token[b]) == (prints[a] == prints[b]) for a in token for b in token) and len(token) == len(rows)
    plain = plain_components(rows)
    assert len(set(got.values())) < len(rows) and all(plain[d] == plain[c] for d, c in got.items())
