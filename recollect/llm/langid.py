"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import finished, held_out, stored, text_slices

#: Columns of a language's table of next states: one for anything between words and its most frequent letters. Its
#: other letters' edges are looked up in a sorted list, so every letter counts in every script.
COLUMNS = 64
#: Texts are parsed in pieces of so many symbols, so that many pieces can go on in step.
PIECE = 512
#: Languages of one model: about 13 MB each in every worker.
MOST_LANGS = 64
UNKNOWN = "und"
CODE_POINTS = 0x110000
#: Bits that name any code point.
LITERAL_BITS = 21


@dataclass(frozen=True)
class Model:
    """Symbols are 0 for anything between words, then the samples' letters in order of code point, then one for letters that
    no sample has. States of all languages are numbered in one row."""

    langs: tuple[str, ...]
    letters: np.ndarray  # code points, in lower case, ascending
    column: np.ndarray  # by symbol and language, COLUMNS where the letter has none
    table: np.ndarray  # next state by state and column, -1: none; the last column is all -1
    keys: np.ndarray  # state * number of symbols + symbol of the edges without a column, ascending
    to: np.ndarray  # where they lead
    first: np.ndarray  # next state of each language's start, by symbol and language
    roots: np.ndarray
    bits: np.ndarray  # log2 of each sample's length


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of the symbols: each state's edges; state 0 is the start.

    It accepts exactly the substrings, so walking it from the start gives the longest match.
    """
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def model_of(langs: tuple[str, ...], letters: np.ndarray, samples: list[np.ndarray]) -> Model:
    """The model of each language's sample of symbols."""
    n = len(letters) + 2
    column = np.full((n, len(langs)), COLUMNS, np.uint8)
    first = np.full((n, len(langs)), -1, np.int32)
    tables, keys, to, roots, at = [], [], [], [], 0
    for k, sample in enumerate(samples):
        counts = np.bincount(sample, minlength=n)
        common = [0, *[c for c in np.argsort(-counts, kind="stable").tolist() if c and counts[c]][: COLUMNS - 1]]
        column[common, k] = np.arange(len(common))
        go = automaton(sample)
        table = np.full((len(go), COLUMNS + 1), -1, np.int32)
        for state, edges in enumerate(go):
            for c, t in edges.items():
                if column[c, k] < COLUMNS:
                    table[state, column[c, k]] = t + at
                else:
                    keys.append((state + at) * n + c)
                    to.append(t + at)
        for c, t in go[0].items():
            first[c, k] = t + at
        tables.append(table)
        roots.append(at)
        at += len(go)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    table = np.concatenate(tables) if tables else np.zeros((0, COLUMNS + 1), np.int32)
    bits = np.array([np.log2(max(2, len(x))) for x in samples])
    return Model(langs, letters, column, table, np.array(keys, np.int64)[order], np.array(to, np.int32)[order], first, np.array(roots, np.int64), bits)


@lru_cache(maxsize=1)
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter, and its lower case where that is one code point."""
    every = list(map(chr, range(CODE_POINTS)))
    letter = np.fromiter((c.isalpha() for c in every), bool, CODE_POINTS)
    lower = np.arange(CODE_POINTS, dtype=np.int32)
    for i in np.flatnonzero(letter).tolist():
        c = every[i].lower()
        if len(c) == 1:
            lower[i] = ord(c)
    return letter, lower


@lru_cache(maxsize=2)
def _numbers(letters: bytes) -> np.ndarray:
    """The symbol of every code point."""
    known = np.frombuffer(letters, np.uint32)
    letter, lower = _unicode()
    number = np.full(CODE_POINTS, len(known) + 1, np.int32)
    number[known] = np.arange(1, len(known) + 1)
    return np.where(letter, number[lower], 0)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(n)]


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols end to end, runs of symbol 0 as one, and where each text starts."""
    points, at = _code_points(texts)
    s = _numbers(letters.astype(np.uint32).tobytes())[points]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
    return s[keep], np.r_[0, np.cumsum(np.bincount(doc[keep], minlength=len(texts)))]


def phrases(s: np.ndarray, at: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By text and language, how many longest matches the text parses into, piece by piece: a phrase ends with its piece;
    and how many of these are symbols that the sample lacks."""
    counts = np.zeros((len(at) - 1, len(model.langs)), np.int64)
    literals = np.zeros_like(counts)
    n = np.diff(at)
    per = -(-n // PIECE)
    doc = np.repeat(np.arange(len(n)), per)
    start = at[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    length = np.minimum(PIECE, at[doc + 1] - start)
    order = np.argsort(-length, kind="stable")
    doc, start, length = doc[order], start[order], length[order]
    if not len(doc):
        return counts, literals
    flat, roots, width, n_symbols = model.table.ravel(), model.roots[None, :], COLUMNS + 1, len(model.letters) + 2
    # Letters of a language's sample that have no column there: their edges are in the sorted list.
    listed = (model.column == COLUMNS) & (model.first >= 0)
    some = listed.any(1)
    state = np.repeat(roots, len(doc), 0)
    found = np.ones((len(doc), len(model.langs)), np.int32)
    alone = np.zeros_like(found)
    left = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    for j, m in enumerate(left.tolist()):
        c = s[start[:m] + j]
        now = state[:m]
        to = flat[now * width + model.column[c]]
        rare = np.flatnonzero(some[c])
        if len(rare):
            i, k = np.nonzero(listed[c[rare]])
            i = rare[i]
            key = now[i, k] * n_symbols + c[i]
            place = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
            to[i, k] = np.where(model.keys[place] == key, model.to[place], -1)
        miss = to < 0
        if miss.any():
            if j:
                found[:m] += miss & (now != roots)
            again = model.first[c]
            # A symbol that the sample lacks is a phrase of its own: the next one begins a phrase too.
            lone = miss & (again < 0)
            if lone.any():
                found[:m] += lone & (j + 1 < length[:m])[:, None]
                alone[:m] += lone
            to = np.where(miss, np.where(again < 0, roots, again), to)
        state[:m] = to
    np.add.at(counts, doc, found)
    np.add.at(literals, doc, alone)
    return counts, literals


def fit(docs: DataFrame, per_language: int = 60, sample: int = 24_000) -> Model:
    """Learns from the texts of at most per_language rows a language, those whose doc_id hashes lowest, and at most
    `sample` symbols of them, a sixteenth of that from one row. Held-out documents are not read. A language takes 0.1 MB at
    the driver while it is learned, and about 13 MB of the model."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.select("doc_id", "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_language).drop("n")
    rows = known.select("doc_id", "lang", F.substring("text", 1, sample // 16).alias("text")).join(F.broadcast(ids.distinct()), ["doc_id", "lang"])
    # Once more, for rows that share a doc_id.
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text"))).where(F.col("n") <= per_language).collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    langs = tuple(sorted({r.lang for r in rows}))
    text = {lang: " ".join(r.text for r in rows if r.lang == lang) for lang in langs}
    letter, lower = _unicode()
    points = np.unique(_code_points(list(text.values()))[0])
    letters = np.unique(lower[points[letter[points]]]).astype(np.uint32)
    return model_of(langs, letters, [symbols([text[lang]], letters)[0][:sample] for lang in langs])


def bits_per_symbol(s: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    counts, literals = phrases(s, at, model)
    return ((counts - literals) * model.bits + literals * LITERAL_BITS) / np.maximum(1, np.diff(at))[:, None]


def closest(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language with the fewest normalised phrases (UNKNOWN for texts without a letter), the bits a symbol that it
    needs and those that the runner-up needs; infinite where there is none."""
    clear = ["" if t is None else t for t in texts]
    letters = np.array([any(map(str.isalpha, t)) for t in clear], bool)
    lang, least, second = [UNKNOWN] * len(texts), np.full(len(texts), np.inf), np.full(len(texts), np.inf)
    if not model.langs or not len(texts):
        return lang, least, second
    s, at = symbols(clear, model.letters)
    need = bits_per_symbol(s, at, model)
    best = need.argmin(1)
    for i in np.flatnonzero(letters):
        lang[i] = model.langs[best[i]]
    least[letters] = need.min(1)[letters]
    if len(model.langs) > 1:
        second[letters] = np.partition(need, 1, axis=1)[letters, 1]
    return lang, least, second


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language with the fewest normalised phrases, the first by name of equal ones, and a score.

    Phrases are normalised by the text's length and by the bits that name a place in the sample, or a code point where the
    sample lacks the symbol, which makes them bits per symbol. The score is how much more the runner-up needs, from 0.5 for the same to 1.
    """
    lang, least, second = closest(texts, model)
    with np.errstate(invalid="ignore"):
        return lang, np.where(np.isinf(least), 0.0, np.where(np.isinf(second), 1.0, second / np.maximum(1e-12, least + second)))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 3 << 20):
            lang, score = predict(part.column("text").to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.round(score, 6))], ["doc_id", "lang_pred", "score"])

    return run


def _merged(model):
    """Rows (doc_id, text, lang_pred, least, second) with what another part of the languages says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 3 << 20):
            new, new_least, new_second = closest(part.column("text").to_pylist(), model.value)
            old, least, second = part.column("lang_pred").to_pylist(), part.column("least").to_numpy(), part.column("second").to_numpy()
            lang = [n if x < y or (x == y and n < o) else o for o, n, x, y in zip(old, new, new_least.tolist(), least.tolist(), strict=True)]
            four = np.sort(np.stack([least, second, new_least, new_second]), axis=0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(lang, pa.string()), pa.array(four[0]), pa.array(four[1])], ["doc_id", "text", "lang_pred", "least", "second"])

    return run


def parts_of(docs: DataFrame) -> int:
    """Into how many parts the languages of docs go, by hash, so that a part's model is of about MOST_LANGS languages at most."""
    n = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).agg(F.count_distinct("lang")).first()[0]
    return 1 if n <= MOST_LANGS else -(-2 * n // MOST_LANGS)


def language_id(docs: DataFrame, per_language: int = 60, sample: int = 24_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Null texts and texts without a letter are `und` with score 0; so is everything if nothing can be learned. Rows that
    repeat a doc_id and a text are predicted alike; a null doc_id is not held out and nothing is learned from it. Of languages
    that need equally many phrases the first by name is predicted, with score 0.5. A long text is parsed whole, in
    pieces of 512 symbols: at a piece's end a phrase ends for every language. Columns but doc_id, text and lang are not
    read, so their names can't clash. Of more than MOST_LANGS languages a part is learned and tried at a time, each in
    a pass over the texts that is written out, so neither the driver nor a worker holds more than a part's model.
    """
    parts = parts_of(docs)
    if parts > 1:
        far = F.lit(float("inf"))
        out = docs.select("doc_id", "text", F.lit(UNKNOWN).alias("lang_pred"), far.alias("least"), far.alias("second"))
        for k in range(parts):
            model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(F.pmod(F.xxhash64("lang"), F.lit(parts)) == k), per_language, sample))
            before, out = out, stored(out.mapInArrow(_merged(model), "doc_id bigint, text string, lang_pred string, least double, second double"), "languages")
            model.destroy()
            finished(before)
        share = F.col("second") / F.greatest(F.lit(1e-12), F.col("least") + F.col("second"))
        score = F.when(F.col("least") == far, 0.0).when(F.col("second") == far, 1.0).otherwise(F.round(share, 6))
        return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", score.alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, sample))
    out = docs.select("doc_id", "text").mapInArrow(_predict(model), "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
