import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recollect.llm import decontam, langid, quality
from recollect.llm import queries as Q
from recollect.llm.mixing import mix, source_targets
from recollect.llm.tokens import TokenCache, count_tokens, token_counts

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(spark, frame, odd):
    t = Tokenizer.from_file(PATH)
    more = [(50, "It's <|endoftext|>. x<|startoftext|>y don't, a.b. '' 's ABC!! ß."), (51, "é. İ. Σ. ª. 1234, a1b2")]
    cache = TokenCache(spark)
    got = {r["doc_id"]: r for r in token_counts(frame(odd + more), PATH, cache).collect()}
    assert len(got) == len(odd) + len(more)
    for d, text in odd + more:
        n = len(t.encode(text or "", add_special_tokens=False))
        assert (got[d]["n_tokens"], got[d]["n_bytes"], got[d]["over_limit"]) == (n, len((text or "").encode()), n > 2048)
    before = cache.read().count()
    token_counts(frame(odd + [(99, "new text")]), PATH, cache).collect()
    assert cache.read().count() == before + 1
    assert token_counts(frame([]), PATH).count() == 0


def test_token_counts_of_corpus(corpus):
    t = Tokenizer.from_file(PATH)
    texts = [x for _, x in corpus]
    assert count_tokens(texts, PATH) == [len(e) for e in t.encode_batch(texts, add_special_tokens=False)]


def _parse(text, sample):
    i = n = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("most", [5, 64])
def test_phrases_are_longest_matches(monkeypatch, most):
    """Of whole texts up to a piece, and piece by piece beyond; with few columns most letters' edges are in the list."""
    monkeypatch.setattr(langid, "COLUMNS", most)
    rng = np.random.default_rng(1)
    a, b = rng.integers(2, 9, 90), rng.integers(2, 16, 80)
    m = langid.model_of(("a", "b"), np.arange(100, 115), [a, b])
    texts = [rng.integers(2, 17, n) for n in (0, 1, 5, 100, 400, 1700)]
    got, _ = langid.phrases(np.concatenate(texts).astype(np.int64), np.r_[0, np.cumsum([len(t) for t in texts])], m)
    piece = langid.PIECE
    plain = [[sum(_parse(bytes(t[i : i + piece].tolist()), bytes(s.tolist())) for i in range(0, len(t), piece)) for s in (a, b)] for t in texts]
    assert got[1:].tolist() == plain[1:]


def test_every_prediction_against_a_plain_parse(frame):
    """The whole operator against phrases counted on plain strings."""
    rng = np.random.default_rng(8)
    pools = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "абвгдежз"}
    some, langs = [], {}
    for i in range(90):
        lang = sorted(pools)[i % 3]
        some.append((i, "".join(rng.choice(list(pools[lang] + "  .A"), int(rng.integers(1, 900))))))
        langs[i] = lang if i % 7 else None
    got = {r["doc_id"]: r for r in langid.language_id(frame(some, langs=langs), per_language=10, sample=1600).collect()}

    def plain(t):
        return re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in t))

    learned = {}
    for lang in pools:
        mine = [d for d, _ in some if langs[d] == lang and zlib.crc32(str(d).encode()) % 5]
        learned[lang] = mine
    model = langid.fit(frame(some, langs=langs), per_language=10, sample=1600)
    for d, t in some:
        s, at = langid.symbols([t], model.letters)
        if not any(map(str.isalpha, t)):
            assert got[d]["lang_pred"] == "und"
            continue
        need = langid.bits_per_symbol(s, at, model)[0]
        assert got[d]["lang_pred"] == model.langs[int(need.argmin())] and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert len(s) == len(plain(t))
    assert all(learned.values())


def test_scripts_without_spaces(frame):
    """Languages whose letters are Han, kana or Hangul, of which one text has more than a table has columns."""
    rng = np.random.default_rng(6)
    pools = {"zh": range(0x4E00, 0x4E00 + 900), "ja": [*range(0x3041, 0x3090), *range(0x5200, 0x5200 + 300)], "ko": range(0xAC00, 0xAC00 + 900), "yi": range(0x5D0, 0x5EA)}
    some, langs = [], {}
    for i in range(120):
        lang = sorted(pools)[i % 4]
        words = ["".join(map(chr, rng.choice(list(pools[lang]), 3))) for _ in range(150)]
        some.append((i, ("" if lang in ("zh", "ja") else " ").join(words)))
        langs[i] = lang
    got = langid.language_id(frame(some, langs=langs)).collect()
    assert all(r["lang_pred"] == langs[r["doc_id"]] for r in got)


def test_ties_and_repeated_rows_of_languages(frame):
    """The same texts under two names tie: the first name by order is predicted. Rows of one doc_id are rows like others."""
    some = [(i // 2, f"same words here {i % 5}") for i in range(80)]
    langs = {i: ("xx", "aa")[i % 2] for i in range(40)}
    got = langid.language_id(frame(some, langs=langs)).collect()
    assert len(got) == 80 and all(0.5 <= r["score"] <= 1 for r in got)
    same = [(i, "one text for all") for i in range(40)]
    assert {(r["lang_pred"], r["score"]) for r in langid.language_id(frame(same, langs=langs), per_language=1).collect()} == {("aa", 0.5)}


def test_language_accuracy(spark):
    got = Q.op3_language_id(spark, SF)
    d = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got.collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["lang_pred"] == d[r["doc_id"]]["lang"] for r in held]) > 0.98


def test_languages_in_parts(spark, frame, odd, monkeypatch):
    """Models of a part of the languages at a time decide as one of all does."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").unionByName(frame(odd).select("doc_id", "text", "lang"))
    rows = lambda: sorted((tuple(r) for r in langid.language_id(docs).collect()), key=repr)
    whole = rows()
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    assert langid.parts_of(docs) > 1 and rows() == whole


def test_language_of_odd_rows(frame, odd):
    texts = [(20 + i, t) for i, t in enumerate(["the cat and the dog", "der hund und die katze"] * 20)]
    langs = {20 + i: ("en", "de")[i % 2] for i in range(40)} | {7: None}
    got = {r["doc_id"]: r for r in langid.language_id(frame(odd + texts, langs=langs)).collect()}
    assert got[7]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[7]["score"] == 0
    assert got[20]["lang_pred"] == "en" and got[21]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.language_id(frame([])).count() == 0


def test_quality_accuracy(spark):
    got = {r["doc_id"]: r for r in Q.op6_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert len(got) == 1000 and np.mean([p == q for p, q in held]) > 0.95


def test_quality_of_odd_rows(spark, frame, odd):
    labels = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(odd)], "doc_id bigint, quality int")
    got = quality.quality_scores(frame(odd), labels).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.quality_scores(frame(odd), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(frame([]), labels).count() == 0
    kept = quality.keep_good(frame(odd), labels)
    assert kept.columns == frame(odd).columns and kept.count() == sum(r["predicted"] for r in got)


def plainly(text, items):
    """The items in a text by containment of shingles alone."""
    w, found = decontam.words(text), set()
    for i, t in items:
        own = decontam.words(t)
        if own:
            run = min(5, len(own))
            q = len(decontam.words(decontam.question_answer(t)[0]))
            parts = own, own[: max(q, run)], own[max(0, min(q, len(own) - run)) :]
            s = decontam.shingles(w, run)
            got = [len(x & s) / len(x) for x in (decontam.shingles(p, run) for p in parts)]
            if got[0] >= 0.8 and min(got) >= 0.5:
                found.add(i)
    return found


def test_contaminated_against_every_item(spark):
    """Plain containment of shingles over all pairs finds the same."""
    got = {(r["doc_id"], r["item_id"]) for r in Q.op8_decontaminate(spark, SF).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {(r["doc_id"], i) for r in docs for i in plainly(r["text"], items)} and got


def test_wand_skips_nothing():
    """Block-max WAND finds the items that scoring every item finds, over lists of many lengths."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    draw = lambda n: list(rng.choice(vocabulary, n, p=share / share.sum()))
    index = decontam.Index([(i, " ".join(draw(int(rng.integers(1, 70))))) for i in range(150)])
    queries = []
    for k in range(600):
        own = draw(40)
        if k % 3 == 0:
            item = index.items[int(rng.integers(0, 150))]
            own = own[:10] + [x for s in sorted(item.whole) for x in s][: int(rng.integers(1, 200))]
        queries.append(sorted({index.term[w] for w in own if w in index.term}))
    none = len(index.term)
    table = np.full((len(queries), max(map(len, queries))), none)
    for row, q in zip(table, queries, strict=True):
        row[: len(q)] = q
    got = sorted(zip(*(x.tolist() for x in index.search(table)), strict=True))
    plain = []
    for k, q in enumerate(queries):
        score = np.zeros(index.n)
        for t in q:
            at = slice(index.start[t], index.start[t + 1])
            score[index.item[at]] += index.impact[at]
        plain += [(k, i) for i in np.flatnonzero(score >= index.need[:-1] - 1e-6).tolist()]
    assert got == sorted(plain) and len(plain) > 100


def test_any_missing_words_leave_enough_score():
    """Of an item that one passage can hold, each copy with 0.8 of the shingles scores what the item needs."""
    rng = np.random.default_rng(12)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 60, int(rng.integers(1, 49))))) for i in range(80)]
    index = decontam.Index(items)
    for item_id, text in items:
        w = text.split()
        miss = int(0.2 * (len(w) - min(5, len(w)) + 1) + 1e-9)
        for copy in (w[miss:], w[: len(w) - miss], w[: len(w) // 2] + ["other"] + w[len(w) // 2 :] if miss > 4 else w):
            got = index.hits([["before"] * 9 + copy + ["after"] * 9])
            whole = next(x for x in index.items if x.item_id == item_id)
            near = decontam.shingles(["before"] * 9 + copy + ["after"] * 9, whole.run)
            if all(len(x & near) / len(x) >= y for x, y in ((whole.whole, 0.8), (whole.question, 0.5), (whole.answer, 0.5))):
                assert item_id in {index.items[i].item_id for i in got[0]}


def test_contamination_of_odd_rows(spark, frame, odd):
    item = "What is the name of the tallest of all the hills here? It is called the great green hill of the north."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short item"), (5, "where " * 200)], "item_id bigint, text string")
    docs = odd + [(60, "before " * 300 + item.upper() + " after" * 90), (61, item.replace("tallest", "highest")), (62, item.split("?")[0]), (63, "a short item of text")]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(docs), bench).collect()}
    assert (60, 1) in got and (63, 4) in got and not any(d in (62, 5, 7) for d, _ in got)
    clean = decontam.clean(frame(docs), bench)
    assert clean.columns == frame(docs).columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontam.contaminated(frame(docs), bench.limit(0)).count() == 0 and decontam.clean(frame([]), bench).count() == 0


def test_several_indexes(spark, frame, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 3)
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contaminated(frame([(100 + i, "pre " + t + " post") for i, t in items]), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(100 + i, i) for i in range(20)]


def test_several_passes_clean_alike(spark, frame, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    monkeypatch.setattr(decontam, "AT_ONCE", 1)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(7)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame([(100 + i, "pre " + t + " post") for i, t in items] + [(5, "nothing of it"), (6, None)])
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {5, 6} and decontam.clean(docs, bench).columns == docs.columns


def test_long_items_are_found(spark, frame):
    """Copies of items of 30 to 400 words with words replaced until 0.8 of the shingles are left, in longer texts."""
    rng = np.random.default_rng(12)
    words = np.array([f"v{i}" for i in range(20_000)])
    share = 1 / np.arange(1, 20_001)
    draw = lambda n: words[rng.choice(20_000, n, p=share / share.sum())].tolist()
    items, docs = [], []
    for n in (30, 48, 60, 100, 200, 400):
        for _ in range(15):
            item = draw(n)
            copy = list(item)
            lost = int(0.2 * (n - 4)) // 5
            for k in range(lost):
                copy[4 + k * ((n - 8) // max(1, lost))] = "replaced"
            items.append((len(items), " ".join(item)))
            docs.append((len(docs), " ".join(draw(200) + copy + draw(200))))
    got = decontam.contaminated(frame(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} >= {(i, i) for i in range(len(items))}


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000], [0, 5, 5, 100], [7]])
def test_targets_by_rounds(spark, sizes):
    """The running sums give what resharing round by round gives."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    fixed = [None] * len(sizes)
    while True:
        left = sum(sizes) - sum(x for x in fixed if x is not None)
        free = sum(w for w, x in zip(weights, fixed, strict=True) if x is None)
        over = [i for i in range(len(sizes)) if fixed[i] is None and 3 * sizes[i] <= left / free * weights[i]]
        if not over:
            break
        for i in over:
            fixed[i] = 3.0 * sizes[i]
        if None not in fixed:
            break
    expected = [x if x is not None else left / free * w for x, w in zip(fixed, weights, strict=True)]
    got = source_targets(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size bigint")).orderBy("source").collect()
    assert [r["target"] for r in got] == pytest.approx(expected)


def test_mix_of_odd_rows(spark, frame, odd):
    sources = {d: (None if d in (5, 9) else f"s{(d or 0) % 3}") for d, _ in odd}
    got = mix(frame(odd, sources)).collect()
    assert len(got) == len(odd) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 1e-6)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(frame(odd, sources)).collect()), key=str)
    assert mix(frame([])).count() == 0


def test_cells_do_not_change_the_sample(spark, frame, corpus):
    a, b = (sorted(map(tuple, mix(frame(corpus), cells=n).collect())) for n in (2, 65536))
    assert a == b


def plain_features(text):
    """Trigram counts and style shares of one text, byte by byte."""
    b = (text or "").encode()
    digits = bytes(48 if 48 <= x <= 57 else x for x in b)
    grams, style = np.zeros(quality.HASHED), np.zeros(quality.STYLE)
    for i in range(len(b) - 2):
        h = (digits[i] * 0x9E3779B1 + digits[i + 1] * 0x85EBCA77 + digits[i + 2] * 0xC2B2AE3D) % 2**32 >> 21
        grams[h] += 1
    words = b.split()
    at = [lambda x: 65 <= x <= 90, lambda x: 33 <= x <= 126 and not chr(x).isalnum() and x not in b",.", lambda x: x in b" \t\n\x0b\x0c\r", lambda x: x >= 128, lambda x: x == 10, lambda x: 48 <= x <= 57]
    for j, f in enumerate(at):
        style[j] = sum(map(f, b)) / max(1, len(b))
    same = lambda u, v: (len(u), sum(u), u[0]) == (len(v), sum(v), v[0])
    style[6] = sum(same(u, v) for u, v in zip(words, words[1:])) / max(1, len(words))
    style[7] = sum(len(w) <= 2 for w in words) / max(1, len(words))
    return grams, style


def test_quality_against_plain_votes(spark, frame, corpus):
    """Every score against votes over all labelled texts, from features, axes and neighbours worked out one text at a time."""
    some = corpus[:90] + [(900, None), (901, ""), (902, "ab"), (903, "A1! " * 40), (5, "a second text of document five")]
    good = {d: d % 3 == 0 for d, _ in corpus[:70]}
    labels = spark.createDataFrame([(d, int(v)) for d, v in good.items()], "doc_id bigint, quality int")
    got = sorted((r["doc_id"], r["score"]) for r in quality.quality_scores(frame(some), labels).collect())

    def x(t, idf):
        grams, style = plain_features(t)
        v = np.log1p(grams) * idf
        return np.r_[v / max(1e-9, np.linalg.norm(v)), np.sqrt(style)]

    learned = [(d, t) for d, t in some if d in good and zlib.crc32(str(d).encode()) % 5]
    idf = np.log((1 + len(learned)) / (1 + sum((plain_features(t)[0] > 0).astype(int) for _, t in learned))) + 1
    m = np.stack([x(t, idf) for _, t in learned])
    y = np.array([good[d] for d, _ in learned], float)
    _, axes = np.linalg.eigh(m.T @ m)
    axes = axes[:, ::-1][:, :48]
    v = m @ axes
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    expected = []
    for d, t in some:
        p = x(t, idf) @ axes
        if plain_features(t)[0].sum() == 0 or np.linalg.norm(p) <= 1e-9:
            expected.append((d, y.mean()))
            continue
        cos = v @ p / np.linalg.norm(p)
        near = np.argsort(-cos, kind="stable")[:25]
        w = np.maximum(cos[near], 1e-6) ** 20
        expected.append((d, (w * y[near]).sum() / w.sum()))
    expected.sort()
    assert [d for d, _ in got] == [d for d, _ in expected]
    off = np.abs(np.array([s for _, s in got]) - np.array([s for _, s in expected]))
    # A neighbour at the 25th place may differ by rounding to single precision.
    assert np.quantile(off, 0.95) < 0.01 and off.max() < 0.2


def test_repeated_rows(spark, frame, odd):
    """Rows that repeat a doc_id, or a doc_id and a text, are rows like others in every operator."""
    twice = odd + odd[3:8] + [(5, "another text of document five with quite other words")]
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    labels = spark.createDataFrame([(5, 1), (5, 0), (9, 0)], "doc_id bigint, quality int")
    assert token_counts(frame(twice), PATH).count() == len(twice)
    assert langid.language_id(frame(twice)).count() == len(twice)
    assert quality.quality_scores(frame(twice), labels).count() == len(twice)
    mixed = mix(frame(twice)).collect()
    assert len(mixed) == len(twice) and sum(r["taken"] for r in mixed) == int(mixed[0]["target"] + 1e-6)
    holders = [d for d, t in twice if t and "one two three four five six seven eight nine ten" in " ".join(t.lower().split())]
    assert sorted(r["doc_id"] for r in decontam.contaminated(frame(twice), bench).collect() if r["doc_id"]) == sorted(d for d in holders * 2 if d)


def test_a_very_long_text(spark, frame):
    """Ten megabytes in one row, beyond every slice, and a copy of its middle elsewhere."""
    rng = np.random.default_rng(17)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 1_000_000)]
    long, part = " ".join(words), " ".join(words[500_000:500_200])
    some = [(1, long), (2, part), (3, "short")]
    assert len(long) > 10_000_000
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(frame(some), PATH).collect()}
    assert got[1] > 1_000_000
    assert {r["doc_id"]: r["size"] for r in mix(frame(some)).collect()} == {1: 1_000_000, 2: 200, 3: 1}
    assert quality.quality_scores(frame(some), spark.createDataFrame([(2, 1), (3, 0)], "doc_id bigint, quality int")).count() == 3
    assert langid.language_id(frame(some)).count() == 3
    bench = spark.createDataFrame([(7, " ".join(words[700_000:700_030]))], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame(some), bench).collect()] == [(1, 7)]
