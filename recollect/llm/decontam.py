"""Benchmark decontamination: block-max WAND over a BM25 index of test items, then overlap of question and answer."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, stored, text_slices

K1, B = 1.2, 0.75
#: Words of a passage and the step from one to the next.
PASSAGE, STEP = 64, 32
#: Postings of a term in a block.
BLOCK = 8
#: Words of an item that some passage is sure to hold, if the text holds them: 48, or all of them.
SURE = PASSAGE - STEP // 2
SHINGLE, OVERLAP, PART = 5, 0.8, 0.5
#: A passage is retrieved at this share of what the words that it is sure to hold score of a longer item.
SHARE = 0.45
#: Items of one index, and indexes of one broadcast.
ITEMS, AT_ONCE = 1000, 16
SLICE = 1 << 20
WORD = re.compile(r"\w+")
EPS = 1e-6


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(w: list[str], k: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of k words; fewer words are one run."""
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def question_answer(text: str | None) -> tuple[str, str]:
    """The item's question and answer: up to its last question mark, else up to its last sentence, else its first half."""
    text = (text or "").strip()
    cut = text.rfind("?") + 1
    if not 0 < cut < len(text):
        cut = text.rstrip(".!? \n").rfind(". ") + 1
    if not 0 < cut < len(text):
        w = text.split()
        return " ".join(w[: (len(w) + 1) // 2]), " ".join(w[(len(w) + 1) // 2 :])
    return text[:cut], text[cut:]


def least_score(impacts: list[float], length: int, run: int) -> float:
    """What a passage scores at least that holds OVERLAP of an item's shingles: any words may be missing, but no more than
    there are shingles that may be. Of an item longer than a passage is sure to hold, a share of what it holds."""
    if length > SURE:
        return SHARE * SURE / length * sum(impacts)
    may_miss = int((1 - OVERLAP) * (length - run + 1) + 1e-9)
    return sum(sorted(impacts)[: len(impacts) - may_miss])


@dataclass
class Item:
    item_id: int
    need: float
    length: int
    run: int  # words of a shingle: five, or all of a shorter item
    whole: set
    question: set
    answer: set


class Index:
    """Inverted lists of at most ITEMS items with BM25 impacts, searched by block-max WAND.

    Items are numbered by the score that they need, so at any place of the lists no later item needs less. Each term has
    its postings in that order, its largest impact, and the largest impact and last item of each block of postings. Many
    queries go on in step, each with cursors of its own: the pivot is the first item up to which the terms'
    largest impacts reach what the foremost item needs; if the blocks around the pivot can't reach what it needs, the
    cursors skip to the end of the nearest block, else they meet at the pivot, which is scored.
    """

    def __init__(self, rows: list[tuple[int, str | None]]):
        bags = [(i, t, words(t)) for i, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))]
        bags = [(i, t, w, Counter(w)) for i, t, w in bags if w]
        n, mean = len(bags), sum(len(w) for _, _, w, _ in bags) / max(1, len(bags))
        df = Counter(t for *_, bag in bags for t in bag)
        self.term = {t: j for j, t in enumerate(df)}
        items = []
        for item_id, text, w, bag in bags:
            q = len(words(question_answer(text)[0]))
            impact = {self.term[t]: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)) for t, tf in bag.items()}
            run = min(SHINGLE, len(w))
            # Both parts as shingles of the item: a short part takes words of the other in.
            parts = shingles(w, run), shingles(w[: max(q, run)], run), shingles(w[max(0, min(q, len(w) - run)) :], run)
            items.append((Item(item_id, least_score(list(impact.values()), len(w), run), len(w), run, *parts), impact))
        items.sort(key=lambda x: (x[0].need, x[0].item_id))
        self.items = [x for x, _ in items]
        self.need = np.array([x.need for x in self.items] + [np.inf])
        postings = sorted((t, i, x) for i, (_, impact) in enumerate(items) for t, x in impact.items())
        self.n = len(items)
        width = self.n + 1
        # Of each posting term * width + item, so that a search finds a term's first posting from an item on.
        self.key = np.array([t * width + i for t, i, _ in postings] + [(len(self.term) + 1) * width], np.int64)
        self.item = np.array([i for _, i, _ in postings] + [self.n], np.int64)
        self.impact = np.array([x for *_, x in postings] + [0.0])
        owner = np.array([t for t, *_ in postings], np.int64)
        self.start = np.searchsorted(owner, np.arange(len(self.term) + 2))
        self.top = np.zeros(len(self.term) + 1)
        np.maximum.at(self.top, owner, self.impact[:-1])
        # Blocks: the number of each posting's, and each block's last item and largest impact.
        place = np.arange(len(owner)) - self.start[owner]
        first = place % BLOCK == 0
        self.block = np.r_[np.cumsum(first) - 1, first.sum()]
        last = np.r_[np.flatnonzero(first)[1:], len(owner)] - 1 if len(owner) else np.zeros(0, int)
        self.block_last = np.r_[self.item[last], self.n]
        self.block_top = np.r_[np.maximum.reduceat(self.impact[:-1], np.flatnonzero(first)) if len(owner) else np.zeros(0), 0.0]

    def _seek(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Where each term's first posting from an item on is; the last place of all where there is none."""
        at = np.searchsorted(self.key, term * (self.n + 1) + item)
        return np.where(at < self.start[term + 1], at, len(self.item) - 1)

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all items that score what they need. query: a row of distinct term numbers each, in ascending order
        and padded with the number of terms."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Queries whose terms can't reach what any item needs end before the first step.
        possible = np.flatnonzero(self.top[query].sum(1) >= self.need[0] - EPS)
        possible = possible[np.argsort((query[possible] < len(self.term)).sum(1), kind="stable")]
        for lo in range(0, len(possible), 4096):
            self._walk(possible[lo : lo + 4096], query, rows, found)
        return np.concatenate(rows), np.concatenate(found)

    def _walk(self, name: np.ndarray, query: np.ndarray, rows: list, found: list) -> None:
        term = query[name]
        term = term[:, : max(1, int((term < len(self.term)).sum(1).max()))]
        end = len(self.item) - 1
        at = np.where(self.start[term] < self.start[np.minimum(term + 1, len(self.term) + 1)], self.start[term], end)
        while len(name):
            item = self.item[at]
            order = np.argsort(item, axis=1)
            ahead = np.take_along_axis(item, order, 1)
            # The pivot: up to it the largest impacts reach what the foremost item needs.
            reach = np.cumsum(np.take_along_axis(np.where(item < self.n, self.top[term], 0.0), order, 1), axis=1) >= self.need[ahead[:, 0]][:, None] - EPS
            where = reach.argmax(1)
            pivot = np.where(reach[np.arange(len(name)), where], ahead[np.arange(len(name)), where], self.n)
            live = pivot < self.n
            if not live.all():
                name, term, at, item, ahead, pivot = (x[live] for x in (name, term, at, item, ahead, pivot))
                if not len(name):
                    return
            inside = item <= pivot[:, None]
            i, j = np.nonzero(inside)
            t, p, mine, now = term[i, j], pivot[i], item[i, j], at[i, j]
            # The cursors' places from the pivot on, and through them the blocks around it.
            to, behind = now.copy(), mine < p
            to[behind] = self._seek(t[behind], p[behind])
            bound = np.bincount(i, self.block_top[self.block[to]], len(name))
            may = bound >= self.need[pivot] - EPS
            full = may & (ahead[:, 0] == pivot)
            here = full[i]
            score = np.bincount(i[here], self.impact[now[here]], len(name))
            hit = np.flatnonzero(full & (score >= self.need[pivot] - EPS))
            rows.append(name[hit])
            found.append(pivot[hit])
            # A scored pivot is passed; cursors meet at one that is to be scored; else they go past the nearest block, or to
            # the first cursor beyond.
            past = now[here] + 1
            to[here] = np.where(past < self.start[t[here] + 1], past, len(self.item) - 1)
            skip = ~may[i]
            if skip.any():
                block_end = np.full(len(name), self.n, np.int64)
                np.minimum.at(block_end, i[skip], self.block_last[self.block[to[skip]]])
                target = np.maximum(pivot + 1, np.minimum(block_end + 1, np.where(inside, self.n, item).min(1)))
                to[skip] = self._seek(t[skip], target[i[skip]])
            at[i, j] = to

    def hits(self, bags: list[list[str]]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text's words, by item: the overlaps of the whole item, its question and its answer with the text
        around the passages that retrieve it."""
        none, get = len(self.term), self.term.get
        ids, starts, doc = [], [], []
        for d, w in enumerate(bags):
            at = np.arange(0, max(1, len(w) - STEP), STEP)
            own = np.full(int(at[-1]) + PASSAGE, none, np.int64)
            own[: len(w)] = np.fromiter(map(get, w, repeat(none)), np.int64, len(w))
            ids.append(own[at[:, None] + np.arange(PASSAGE)])
            starts.append(at)
            doc.append(np.full(len(at), d))
        out: list[dict] = [{} for _ in bags]
        if not bags:
            return out
        query, starts, doc = np.concatenate(ids), np.concatenate(starts), np.concatenate(doc)
        query.sort(axis=1)
        query[:, 1:][query[:, 1:] == query[:, :-1]] = none  # each term once
        query.sort(axis=1)
        for k, i in zip(*(x.tolist() for x in self.search(query)), strict=True):
            item, w, s = self.items[i], bags[doc[k]], int(starts[k])
            near = shingles(w[max(0, s - item.length) : s + PASSAGE + item.length], item.run)
            got = tuple(len(x & near) / len(x) for x in (item.whole, item.question, item.answer))
            if got[0] >= OVERLAP and got[1] >= PART and got[2] >= PART:
                out[doc[k]][i] = max(out[doc[k]].get(i, got), got)
        return out


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            rows, ids, bags = [], part.column("doc_id").to_pylist(), [words(t) for t in part.column("text").to_pylist()]
            for ix in shared.value:
                for doc, found in zip(ids, ix.hits(bags), strict=True):
                    rows += [(doc, ix.items[i].item_id, *(round(x, 6) for x in got)) for i, got in sorted(found.items())]
            if rows:
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "overlap", "question_overlap", "answer_overlap"])

    return run


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            bags = [words(t) for t in part.column("text").to_pylist()]
            keep = np.ones(len(bags), bool)
            for ix in shared.value:
                keep &= np.array([not found for found in ix.hits(bags)], bool)
            yield part.filter(pa.array(keep))

    return run


def indexes(benchmark: DataFrame) -> tuple[int, Iterator]:
    """How many passes over the documents the benchmark takes, and for each a broadcast of at most AT_ONCE indexes of ITEMS items.

    The benchmark is counted first and collected in parts by hash, each when its pass begins, so no more than one part's
    items are at the driver; a larger benchmark means more passes."""
    spark = benchmark.sparkSession
    rows = benchmark.where("item_id is not null").select("item_id", "text")
    n = rows.count()
    parts = -(-n // (ITEMS * AT_ONCE))

    def each():
        for k in range(parts):
            mine = [tuple(r) for r in (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)).collect()]
            yield spark.sparkContext.broadcast([Index(mine[i : i + ITEMS]) for i in range(0, len(mine), ITEMS)])

    return parts, each()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, overlap, question_overlap, answer_overlap: a row for each row of docs and test item in it.

    Every passage of 64 words, each 32 words on from the last, is a query; a text of any length is cut into its passages.
    Items that a passage scores enough for are verified: 0.8 or more of their five-word shingles, and half of those of
    both question and answer, are in the text around the passage. An item of fewer than five words is one shingle. Items
    of up to 48 words can't be missed, whichever of their words a copy lacks; longer ones are retrieved at 0.45 of what
    48 of their words score on average. Words are \\w+ in lower case. Null or empty texts and items match nothing; items
    with a null item_id are left out; rows that repeat a doc_id or item_id are looked at each, and an item that is
    found at several places, or as good at several, is reported once with its best overlaps. Other columns are not
    read. The index is broadcast, 16,000 items at a time (about 60 MB): where there are more, the hits of each pass are
    written out before the next one's index is made. No document is shuffled, so no source or copy is hot.
    """
    d = docs.select("doc_id", "text")
    out = None
    passes, each = indexes(benchmark)
    for index in each:
        hits = d.mapInArrow(_search(index), "doc_id bigint, item_id bigint, overlap double, question_overlap double, answer_overlap double")
        if passes > 1:
            hits = stored(hits, "contaminated")
            index.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, overlap double, question_overlap double, answer_overlap double")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that hold no test item."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"))
    passes, each = indexes(benchmark)
    for index in each:
        before, packed = packed, packed.mapInArrow(_clean(index), packed.schema)
        if passes > 1:
            packed = stored(packed, "clean")
            finished(before)
            index.destroy()
    return packed.select(*[F.col("text") if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
