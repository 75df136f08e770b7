import brute
import numpy as np
import pandas as pd
import pytest

from recollect.llm import lines as lines_module
from recollect.llm import queries as Q
from recollect.llm import suffix as suffix_module
from recollect.llm.common import aligned
from recollect.llm.components import components
from recollect.llm.exact import DigestIndex, digests, exact_dedup
from recollect.llm.lines import CuckooFilter, LineIndex, _delete, line_dedup
from recollect.llm.simhash import near_links, simhash_dedup
from recollect.llm.substring import FingerprintIndex, dedup_batch, substring_dedup
from recollect.llm.suffix import Splitters, multikey_order, suffix_dedup

ORDER = lambda r: (r[0] is None, r)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def check(df, columns, expected):
    assert rows(df, *columns) == sorted(expected, key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(against_sql, name):
    against_sql(Q.queries()[name], Q.oracle_sql()[name])


CASES = {
    "simhash": (simhash_dedup, ("doc_id", "fingerprint", "component_id"), brute.simhash),
    "suffix": (lambda d: suffix_dedup(d, 400), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), lambda r: brute.suffix(r, 400)),
    "suffix short": (lambda d: suffix_dedup(d, 40), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), lambda r: brute.suffix(r, 40)),
    "substring": (lambda d: substring_dedup(d, 50), ("doc_id", "n_words", "n_removed", "kept_sha256"), lambda r: brute.substring(r, 50)),
    "substring short": (lambda d: substring_dedup(d, 8, batches=(0.3, 0.5, 0.8)), ("doc_id", "n_words", "n_removed", "kept_sha256"), lambda r: brute.substring(r, 8)),
    "lines": (line_dedup, ("doc_id", "n_lines", "n_dropped", "kept_sha256"), brute.lines),
    "exact": (exact_dedup, ("doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_odd_rows(frame, odd, case):
    run, columns, plain = CASES[case]
    check(run(frame(odd)), columns, plain(odd))


@pytest.mark.parametrize("case", sorted(CASES))
def test_no_rows(frame, case):
    run, columns, _ = CASES[case]
    check(run(frame([])), columns, [])


@pytest.mark.parametrize("case", ["simhash", "suffix", "suffix short", "substring", "substring short"])
def test_corpus(frame, corpus, case):
    run, columns, plain = CASES[case]
    some = corpus if "short" not in case else corpus[:60]
    check(run(frame(some)), columns, plain(some))


def test_repeated_rows(frame, odd):
    twice = [r for r in odd if r[0] in (5, 9, 3)] * 2
    got = rows(exact_dedup(frame(twice)), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(3, 3, 2, True), (5, 5, 4, True), (9, 5, 4, False)] * 2, key=str)
    assert len(rows(simhash_dedup(frame(twice)), "doc_id")) == 6


def test_hot_bucket_of_fingerprints(spark):
    """Fingerprints that share their high bits fall in one bucket, which is cut into chunks."""
    rng = np.random.default_rng(5)
    prints = sorted({int(x) for x in rng.integers(0, 2**18, 700)})
    links = near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 3, chunk=64)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            break
        label = new
    assert [got.get(p, p) for p in prints] == [prints[i] for i in label]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 4, 30000) for _ in range(6)]
    order = multikey_order(columns, small=50)
    assert (order == np.lexsort(columns[::-1])).all() or (np.stack(columns)[:, order] == np.stack(columns)[:, np.lexsort(columns[::-1])]).all()


@pytest.mark.parametrize(("values", "buckets", "most"), [(3, 8, 10_000), (2**40, 64, 10_000), (2**40, 64, 5), (2, 40, 3)])
def test_splitters_keep_the_order(monkeypatch, values, buckets, most):
    """Buckets are ranges of the whole rows, also where a hot first token is split and where ranges are cut evenly."""
    monkeypatch.setattr("recollect.llm.suffix.SPLITTERS", most)
    rng = np.random.default_rng(values % 97)
    first = rng.integers(0, values, 4000) if values < 100 else rng.integers(-(2**63), 2**63 - 1, 4000)
    columns = [first, *(rng.integers(0, 5, 4000, np.int32) for _ in range(4)), rng.integers(-(2**62), 2**62, 4000), *(rng.integers(0, 2**20, 4000) for _ in range(4))]
    s = Splitters([c[::7] for c in columns], buckets)
    bucket = s.bucket(columns)
    order = np.lexsort(columns[::-1])
    assert (np.diff(bucket[order]) >= 0).all() and 0 <= bucket.min() and bucket.max() < s.buckets
    assert np.bincount(bucket).max() < 4000 / min(buckets, 100) * 4


def test_ranges_beyond_the_cap(monkeypatch, frame):
    """More buckets than the driver's splitters: ranges are cut by their own rows, a hot first token's range too."""
    monkeypatch.setattr(suffix_module, "SPLITTERS", 5)
    monkeypatch.setattr(suffix_module, "BUCKET_BYTES", 4000)
    sizes = []
    plain = suffix_module.neighbours

    def counted(suffixes, buckets):
        sizes.extend(r["count"] for r in suffixes.groupBy("bucket").count().collect())
        return plain(suffixes, buckets)

    monkeypatch.setattr(suffix_module, "neighbours", counted)
    rng = np.random.default_rng(6)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    unit = letters(96)
    some = [(i, letters(300) + (unit * 9 if i % 3 == 0 else letters(700)) + letters(200)) for i in range(150)]
    check(suffix_dedup(frame(some)), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.suffix(some, 400))
    assert len(sizes) > 20 and max(sizes) < 4 * sum(sizes) / len(sizes)


def test_one_passage_in_thousands_of_rows(spark, frame):
    """A 400-byte passage between differing texts: each window of its edge is alone but for the passage itself."""
    rng = np.random.default_rng(4)
    passage = "".join(map(chr, rng.integers(97, 123, 400)))
    some = [(i, f"{i} {rng.integers(0, 2**60)} " * 9 + passage + f" {rng.integers(0, 2**60)} {i}" * 9) for i in range(3000)]
    got = suffix_dedup(frame(some)).collect()
    assert all(r["n_removed"] >= 400 for r in got) and len(got) == 3000
    few = some[:40]
    check(suffix_dedup(frame(few)), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.suffix(few, 400))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, (20000, 2), np.uint64, endpoint=False)
    f = CuckooFilter(len(keys))
    f.insert(keys[:12000])
    f.insert(keys[12000:])
    f = CuckooFilter(blob=f.blob())
    assert f.contains(keys).all()
    f.delete(keys[:10000])
    assert f.contains(keys[10000:]).all()
    assert f.contains(keys[:10000]).mean() < 0.01


def test_small_cuckoo_filters():
    for seed in range(400):
        keys = np.random.default_rng(seed).integers(0, 2**64, (seed % 40 + 1, 2), np.uint64, endpoint=False)
        assert CuckooFilter.of(keys).contains(keys).all()


def test_deletion_of_a_key_that_a_filter_only_seemed_to_hold():
    own, other = (np.array([[0, (5 << 48) + i]], np.uint64) for i in (1, 2))
    filters = pd.DataFrame({"shard": [3], "blob": [CuckooFilter.of(own).blob()]})
    keyed = pd.DataFrame({"shard": 3, "key": [own.tobytes(), other.tobytes()], "held": [True, False]})
    left = [CuckooFilter(blob=b) for b in _delete(keyed, filters)["blob"]]
    assert any(f.contains(own).all() for f in left)


def test_line_deletion_is_as_if_never_inserted(spark, frame, odd):
    index = LineIndex(spark, shards=4)
    some = [r for r in odd if r[0] in (2, 8)]
    index.insert(frame(some))
    index.insert(frame([(20, some[0][1])]))
    assert {r["doc_id"] for r in index.drops().collect()} == {8, 20}
    index.delete(spark.createDataFrame([(2,)], "doc_id bigint"))
    assert {r["doc_id"] for r in index.drops().collect()} == {20}
    index.delete(spark.createDataFrame([(8,)], "doc_id bigint"))
    assert not index.drops().collect()
    index.insert(frame([(1, some[0][1])]))
    assert {r["doc_id"] for r in index.drops().collect()} == {20}


def test_line_index_goes_on_where_it_ended(spark, frame, odd):
    """Batches, a deletion and a new batch, each through an index opened anew at the same path; the filters of shards
    that a deletion does not touch stay as they are."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/line-index-test"
    more = [(30 + i, "\n".join(f"line number {j} of some" for j in range(i, i + 40))) for i in range(6)]
    LineIndex(spark, path, shards=8).insert(frame(more[:3]))
    LineIndex(spark, path).insert(frame(more[3:] + [(50, "only here: a line\nand one more line")]))
    before = {r["shard"]: bytes(r["blob"]) for r in LineIndex(spark, path).filters.collect() if r["shard"] is not None}
    index = LineIndex(spark, path)
    assert index.shards == 8
    expected = {d for d, _, n, _ in brute.lines(more) if n}
    assert {r["doc_id"] for r in index.drops().collect()} == expected
    touched = {r["shard"] for r in index.refs.where("doc_id = 50").collect()}
    assert len(touched) < 8
    index.delete(spark.createDataFrame([(50,)], "doc_id bigint"))
    index = LineIndex(spark, path)
    after = {r["shard"]: bytes(r["blob"]) for r in index.filters.collect()}
    assert all(after[k] == v for k, v in before.items() if k not in touched)
    assert index.refs.where("doc_id = 50").count() == 0
    index.delete(spark.createDataFrame([(30,)], "doc_id bigint"))
    index.insert(frame([(50, more[0][1])]))
    assert {r["doc_id"] for r in LineIndex(spark, path).drops().collect()} == {d for d, _, n, _ in brute.lines(more[1:] + [(50, more[0][1])]) if n}


def test_line_index_compacts_itself(spark, frame, monkeypatch):
    """Many batches and deletions: few filters a shard, more shards as it grows, decisions as without any of it."""
    monkeypatch.setattr(lines_module, "MOST_FILTERS", 3)
    monkeypatch.setattr(lines_module, "SHARD_REFS", 20)
    rng = np.random.default_rng(9)
    index, now = LineIndex(spark, shards=2), {}
    for b in range(6):
        some = [(100 * b + i, "\n".join(f"a line of number {x}" for x in rng.integers(0, 60, 8))) for i in range(6)]
        index.insert(frame(some))
        now |= dict(some)
        if b in (2, 4):
            index.delete(spark.createDataFrame([(100 * b,), (100,)], "doc_id bigint"))
            now = {d: t for d, t in now.items() if d not in (100 * b, 100)}
        again = LineIndex(spark, index.path)
        assert {r["doc_id"] for r in again.drops().collect()} == {d for d, _, n, _ in brute.lines(list(now.items())) if n}
    assert again.shards > 2 and again.filters.groupBy("shard").count().agg({"count": "max"}).first()[0] <= 4
    assert again.refs.count() == sum(len({x for x in t.split("\n")}) for t in now.values())


def test_filters_decide_which_lines_are_counted(spark, frame):
    """References of keys that no filter held again are not read by the exact count."""
    index = LineIndex(spark, shards=4)
    index.insert(frame([(1, "a line that is shared\na line of one alone"), (2, "quite another line here")]))
    index.insert(frame([(3, "a line that is shared\nand a new line to see")]))
    assert index.refs.count() == 5 and index.shared.select("key").distinct().count() == 1
    assert [(r["doc_id"], len(r["keys"])) for r in index.drops().collect()] == [(3, 1)]


def test_digest_index_persists(spark, frame):
    first = DigestIndex(spark, buckets=4, most_files=2)
    first.add(digests(frame([(5, "a b"), (6, "c")])))
    again = DigestIndex(spark, first.path, most_files=2)
    assert (again.buckets, again.files) == (4, 1)
    again.add(digests(frame([(1, "a  b"), (2, "d"), (3, "d")])))
    assert sorted(r["keep_id"] for r in again.owners().collect()) == [2, 5, 6]
    again.add(digests(frame([(9, "e")])))  # the third file a bucket: compacted
    assert again.version == 1 and again.files == 1
    third = DigestIndex(spark, first.path)
    assert third.version == 1 and sorted(r["keep_id"] for r in third.owners().collect()) == [2, 5, 6, 9]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digest_index_is_neither_shuffled_nor_sorted(spark, frame):
    index = DigestIndex(spark, buckets=6)
    index.add(digests(frame([(i, f"text {i}") for i in range(300)])))
    batch = digests(frame([(i, f"text {i}") for i in range(200, 400)])).selectExpr("text_sha256", "doc_id as keep_id")
    with index._aligned():
        plan = plan_of(index.new_texts(batch))
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1  # the batch's


def test_fingerprint_index_over_batches(spark, frame, corpus, monkeypatch):
    """Batches in any order of doc_id up to the end of the history, each through an index opened anew; runs are compacted
    on the way, and grams of several entries are split."""
    monkeypatch.setattr("recollect.llm.substring.PART", 2)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/fingerprint-index-test"
    some = corpus[:80]
    got = []
    for lo in range(0, 80, 20):
        index = FingerprintIndex(spark, path, window=8, most_runs=1, docs=frame(some[:lo]) if lo else None)
        got += [tuple(r) for r in dedup_batch(index, frame(some[lo : lo + 20])).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert len(index.runs) <= 2
        index.close()
    assert sorted(got) == sorted(brute.substring(some, 8))
    with pytest.raises(ValueError):
        FingerprintIndex(spark, path)


def test_runs_are_merged_without_shuffle_or_sort(spark, frame, corpus):
    """Of a run's tables neither is shuffled or sorted when a batch is joined with it."""
    index = FingerprintIndex(spark, window=20)
    dedup_batch(index, frame(corpus[:60]))
    dedup_batch(index, frame(corpus[60:120]))
    with aligned(spark, index.buckets):
        grams = index.table("grams", 1).join(index.table("grams", 2).withColumnRenamed("n", "m").hint("merge"), "gram")
        entries = index._parted(spark.createDataFrame([(1, 2, 3)], "gram bigint, around bigint, beyond int"), 1).join(index.table("entries", 1).hint("merge"), ["gram", "part", "around", "beyond"])
        plan, other = plan_of(grams), plan_of(entries)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert other.count("Exchange hashpartitioning(gram") <= 2 and "SortMergeJoin" in other
    last = other[other.rindex("SortMergeJoin") :] if "parts" in other else other
    assert "Bucketed: true" in last


@pytest.mark.parametrize("apart", [False, True])
def test_passage_twice_in_one_document(spark, frame, apart):
    """Both copies have the same surroundings, so the document owns them itself; a smaller doc_id has them in others."""
    some = []
    for k, n in enumerate((60, 80, 120)):
        x, left, right, other, more = (" ".join(f"{c}{k}w{i}" for i in range(m)) for c, m in (("x", n), ("a", 70), ("b", 70), ("c", 70), ("d", 70)))
        q = f"{other} {x} {more}"
        some += [(k, f"{left} {x} {right}"), (10 + k, f"{q} {q}"), (20 + k, f"{q} one"), (20 + k, f"{q} two")]
    index = FingerprintIndex(spark)
    got = []
    for part in [[r for r in some if r[0] < 10], [r for r in some if r[0] >= 10]] if apart else [some]:
        got += rows(dedup_batch(index, frame(part)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got) == sorted(brute.substring(some, 50))
    own = frame([r for r in some if r[0] >= 20 or r[0] < 10])
    check(substring_dedup(own, 50, batches=(0.5,)), ("doc_id", "n_words", "n_removed", "kept_sha256"), brute.substring([tuple(r) for r in own.select("doc_id", "text").collect()], 50))


def test_repeated_rows_of_every_dedup(frame, odd):
    twice = odd + odd[3:8] + [(5, "another text of document five with quite other words than those before")]
    for case, (run, columns, plain) in CASES.items():
        if case not in ("lines", "suffix"):  # there rows of one doc_id are one document, or each other's copies
            check(run(frame(twice)), columns, plain(twice))
    assert len(rows(line_dedup(frame(twice)), "doc_id")) == len(rows(suffix_dedup(frame(twice)), "doc_id")) == len(twice)


def test_a_very_long_text(frame):
    """Three megabytes in one row, beyond every slice, and copies of its middle in two others."""
    rng = np.random.default_rng(18)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 300_000)]
    part = " ".join(words[150_000:150_200])
    some = [(1, " ".join(words)), (2, part), (3, f"before {part} after"), (4, "short")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup(frame(some)).collect()}
    assert got[2] == (len(part), 1) and got[4] == (0, 0) and got[1][1] == 1 and len(part) <= got[1][0] <= len(part) + 2
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(frame(some)).collect()}
    assert got == {1: 0, 2: 200, 3: 200, 4: 0}
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup(frame(some)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert len(rows(simhash_dedup(frame(some)), "doc_id")) == len(rows(exact_dedup(frame(some)), "doc_id")) == 4
