"""Spelling variants: words one edit apart by dynamic programming over a sorted list, and each word's more frequent form."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, stored, text_offsets
from .repeats import ranges, runs

#: A word has so many code points and occurrences at least.
LENGTH, TIMES = 7, 2
#: One of so many runs loses a code point.
TYPO = 31
#: A word's form is so many times as frequent.
RATIO = 10
#: Words of a block scanned in one piece of work; larger blocks are dealt out as pairs of chunks.
CHUNK = 20_000
#: Rows of whole blocks that are scanned together.
TOGETHER = 50_000
#: Ranges of lists that are gone through side by side.
ACTIVE = 1 << 20


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all runs of letters after the contract's deletions: at least LENGTH code points and TIMES occurrences.

    A null text has no run; a null doc_id is hashed as the word null.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-zÀ-ÿ]{{{LENGTH},}})"), F.lit(1))).alias("run"))
    low = runs.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("low"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("low")).cast("binary"))
    low = low.select("low", h.alias("h"))
    at = (F.col("h") % F.length("low")).cast("int")
    cut = F.concat(F.col("low").substr(F.lit(1), at), F.col("low").substr(at + 2, F.length("low")))
    words = low.select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("low")).alias("word"))
    return words.where(F.length("word") >= LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)


def blocks(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """block, x, y, side, text, keep, n: the rows that the scans read, for every pair of words one edit apart one common block.

    Words one edit apart agree on all before or all after the edit. A query of L code points looks forward for words that
    share its first L // 2, and backward (with all words reversed) for words that share its last L - L // 2: one of the
    two holds. side 0 is the sorted list, side 1 the queries. keep is the length of the shared part; a word is
    listed for every length that a query of nearly its own length may keep.
    """
    size = F.length("word")
    half = lambda n, back: (n - F.floor(n / 2)) if back else F.floor(n / 2)
    out = None
    for back in (False, True):
        text = F.reverse("word") if back else F.col("word")
        listed = F.array_distinct(F.array(*[half(size + i, back) for i in (-1, 0, 1)]))
        w = words.select(text.alias("text"), "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), half(size, back).alias("own"), listed.alias("listed"))
        w = w.select("text", "n", "side", F.explode(F.when(F.col("side") == 1, F.array("own")).otherwise(F.col("listed"))).alias("keep"))
        block = F.concat(F.lit("b" if back else "f"), F.col("keep").cast("string"), F.lit(" "), F.expr("substring(text, 1, cast(keep as int))"))
        w = w.select(block.alias("block"), "side", "text", F.col("keep").cast("int").alias("keep"), "n")
        out = w if out is None else out.unionByName(w)
    out = stored(out, "blocks")
    # A block without another word, or without a query, has no pair.
    sizes = out.groupBy("block").agg(F.count_if(F.col("side") == 0).alias("words"), F.count_if(F.col("side") == 1).alias("asked")).where("words > 1 and asked > 0")
    sizes = sizes.select("block", F.ceil(F.col("words") / chunk).alias("parts"))
    b = out.join(sizes, "block").withColumn("own", F.pmod(F.xxhash64("text"), F.col("parts")))
    # A chunk of the list meets every chunk of the queries once.
    b = b.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    x, y = (F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")) for s in (0, 1))
    return b.select("block", x.alias("x"), y.alias("y"), "side", "text", "keep", "n")


def points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words end to end, and where each starts (one more entry for the end)."""
    words = col.to_pylist()
    at = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), at


def common_prefixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """How many code points each word of a sorted list shares with the one before it; -1 where a new list begins."""
    lcp = np.zeros(len(start), np.int64)
    most = np.minimum(size[1:], size[:-1])
    alive = np.flatnonzero(~fresh[1:])
    d = 0
    while len(alive):
        alive = alive[most[alive] > d]
        alive = alive[flat[start[alive] + d] == flat[start[alive + 1] + d]]
        lcp[alive + 1] += 1
        d += 1
    lcp[fresh] = -1
    return lcp


def scan(flat: np.ndarray, start: np.ndarray, size: np.ndarray, lcp: np.ndarray, ask: np.ndarray, first: np.ndarray, last: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in ask, word) one edit apart, of queries and words of their sorted lists first..last - 1.

    flat, start, size: code points of all words, the listed ones first; lcp: what those share with the one before. ask: the queries' words;
    their lists agree with them on keep code points. The edit matrix of a query has a row for each prefix of
    a word, of which three cells can be 1 or less. Words that follow each other in the list share the rows of their
    common prefix: the list is gone through as ranges that share a prefix, each split where the common prefix of
    neighbours ends, so a row is made once for all words of a range. A range whose row is above one edit is skipped.
    """
    order = np.argsort(lcp, kind="stable")
    ends = np.searchsorted(lcp[order], np.arange(int(lcp.max(initial=0)) + 2))
    q, low, high, depth = np.arange(len(ask)), first.copy(), last.copy(), keep.copy()
    a, b, c = np.ones(len(q), np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
    c[size[ask] == keep] = 2
    found_q, found_w = [], []
    waiting = np.argsort(depth, kind="stable")  # queries join when the scan comes to the prefix that they keep
    d = int(depth.min(initial=0))
    entered = 0
    state = [x[:0] for x in (q, low, high, a, b, c)]
    while entered < len(waiting) or len(state[0]):
        upto = int(np.searchsorted(depth[waiting], d, side="right"))
        if upto > entered:
            new = waiting[entered:upto]
            state = [np.r_[s, x[new]] for s, x in zip(state, (q, low, high, a, b, c), strict=True)]
            entered = upto
        sq, lo, hi, ra, rb, rc = state
        if not len(sq):
            d = int(depth[waiting[entered]])
            continue
        long = size[ask[sq]]
        # A word that ends here is the first of its range.
        done = size[lo] == d
        cell = np.where(long == d, rb, np.where(long == d - 1, ra, np.where(long == d + 1, rc, 2)))
        hit = done & (cell == 1)
        found_q.append(sq[hit])
        found_w.append(lo[hit])
        lo = lo + done
        left = lo < hi
        sq, lo, hi, ra, rb, rc, long = (x[left] for x in (sq, lo, hi, ra, rb, rc, long))
        # Split each range where neighbours share d code points only.
        cuts = order[ends[d] : ends[d + 1]] if d + 1 < len(ends) else order[:0]
        i, j = np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi, side="left")
        parts = np.repeat(np.arange(len(sq)), j - i + 1)
        head = np.ones(len(parts), bool)
        head[1:] = parts[1:] != parts[:-1]
        begin = np.empty(len(parts), np.int64)
        begin[head], begin[~head] = lo, cuts[ranges(i, j)]
        stop = np.empty(len(parts), np.int64)
        stop[:-1] = begin[1:]
        tail = np.r_[head[1:], np.ones(min(1, len(parts)), bool)]
        stop[tail] = hi
        sq, ra, rb, rc, long = (x[parts] for x in (sq, ra, rb, rc, long))
        # The row of one code point more: cells d, d + 1 and d + 2 of the query.
        point, own = flat[start[begin] + d], start[ask[sq]]
        other = [(flat[np.minimum(own + k, len(flat) - 1)] != point).astype(np.int8) for k in (d - 1, d, d + 1)]
        na = np.minimum(ra + other[0], rb + 1)
        nb = np.minimum(np.minimum(rb + other[1], rc + 1), na + 1)
        nc = np.minimum(rc + other[2], nb + 1)
        na[long < d], nb[long < d + 1], nc[long < d + 2] = 2, 2, 2
        alive = np.minimum(np.minimum(na, nb), nc) <= 1
        state = [x[alive] for x in (sq, begin, stop, np.minimum(na, 2), np.minimum(nb, 2), np.minimum(nc, 2))]
        d += 1
    return np.concatenate(found_q) if found_q else q[:0], np.concatenate(found_w) if found_w else q[:0]


def _near(t: pa.Table) -> pa.RecordBatch:
    """word, n_near, near_n, near of every query of whole blocks that has a near word in its list: how many, and the most
    frequent one (of equal ones the first in order)."""
    t = t.combine_chunks()
    side = t.column("side").to_numpy()
    block = t.column("block").combine_chunks()
    back = np.frombuffer(block.buffers()[2], np.uint8)[text_offsets(block)[:-1]] == ord("b") if len(t) else np.zeros(0, bool)
    _, name = np.unique(t.column("block").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    piece = np.stack([name, t.column("x").to_numpy(), t.column("y").to_numpy()], 1)
    change = np.ones(len(t), bool)
    change[1:] = (piece[1:] != piece[:-1]).any(1)
    piece = np.cumsum(change) - 1
    listed, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    both = np.r_[listed, asked]
    flat, at = points(t.column("text").take(pa.array(both)).combine_chunks())
    start, size = at[:-1], np.diff(at)
    mine = piece[listed]
    fresh = np.ones(len(listed), bool)
    fresh[1:] = mine[1:] != mine[:-1]
    first, last = np.searchsorted(mine, piece[asked], "left"), np.searchsorted(mine, piece[asked], "right")
    some = first < last
    asked, first, last = asked[some], first[some], last[some]
    ask = len(listed) + np.flatnonzero(some)
    keep = t.column("keep").to_numpy()[asked].astype(np.int64)
    # A query has no more ranges at a time than its list has words: so many queries together as ACTIVE allows.
    together = np.cumsum(last - first) // ACTIVE
    lcp = common_prefixes(flat, start[: len(listed)], size[: len(listed)], fresh)
    found = [scan(flat, start, size, lcp, ask[a:b], first[a:b], last[a:b], keep[a:b]) for a, b in zip(*runs(together), strict=True)]
    shift = runs(together)[0]
    i = np.concatenate([f[0] + a for f, a in zip(found, shift, strict=True)]) if found else np.zeros(0, np.int64)
    j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    # Pairs that the forward scan finds are not counted again by the backward one: those share a long enough prefix,
    # which is the end of the reversed words.
    behind = back[asked[i]]
    own, whole = size[ask[i]], np.minimum(size[ask[i]], size[j])
    same = np.zeros(len(i), np.int64)
    alive = np.flatnonzero(behind)
    d = 1
    while len(alive):
        alive = alive[(whole[alive] >= d) & (same[alive] < own[alive] // 2)]
        alive = alive[flat[start[ask[i[alive]]] + own[alive] - d] == flat[start[j[alive]] + size[j[alive]] - d]]
        same[alive] += 1
        d += 1
    fine = ~behind | (same < own // 2)
    i, j = i[fine], j[fine]
    n = t.column("n").to_numpy()[listed]
    texts = t.column("text").to_numpy(zero_copy_only=False)
    words = np.array([x[::-1] if b else x for x, b in zip(texts[listed[j]], back[listed[j]], strict=True)], object)
    rank = np.zeros(len(j), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(j))
    order = np.lexsort((rank, -n[j], i))
    i, j, words = i[order], j[order], words[order]
    head = np.ones(len(i), bool)
    head[1:] = i[1:] != i[:-1]
    count = np.diff(np.r_[np.flatnonzero(head), len(i)])
    who = [x[::-1] if b else x for x, b in zip(texts[asked[i[head]]], back[asked[i[head]]], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(count), pa.array(n[j[head]]), pa.array(words[head].tolist(), pa.string())], ["word", "n_near", "near_n", "near"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of blocks(), a piece all in one partition and in order, the queries' near words piece by piece."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < TOGETHER:
            continue
        t = pa.Table.from_batches(held)
        # The last piece may go on in the next batch.
        final = [t.column(c)[len(t) - 1].as_py() for c in ("block", "x", "y")]
        low = len(t)
        while low and [t.column(c)[low - 1].as_py() for c in ("block", "x", "y")] == final:
            low -= 1
        if low:
            yield _near(t.slice(0, low))
        held = t.slice(low).to_batches()
        rows = len(t) - low if low else 0  # one large piece waits for all its rows
    if held:
        yield _near(pa.Table.from_batches(held))


def near_words(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, n_near, near_n, near for words (word, n) that have another one edit away: how many, and the most frequent."""
    b = blocks(words, chunk).repartition("block", "x", "y").sortWithinPartitions("block", "x", "y", "side", "text")
    part = b.mapInArrow(_scanned, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    out = part.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form) lead to in the end. Each round doubles the steps, and a form is RATIO times
    as frequent as its word, so a few rounds are enough for any table."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = stored(reached.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "forms")
        more = new.where("moved").limit(1).count()
        finished(reached)
        reached = new
        if not more:
            return reached.select("word", "root")


def spelling_variants(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of vocabulary(docs).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its most
    frequent near word (of equal ones the first in code-point order) if that has RATIO times its occurrences, else null;
    root follows the forms to the last. Null and empty texts have no words, repeated rows count again, very long words
    are words like others, and an empty table gives no row; other columns are not read.
    """
    words = stored(vocabulary(docs), "words")
    near = stored(near_words(words, chunk), "near")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    w = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    w = stored(w, "variants")
    finished(words, near)
    end = roots(w.where("form is not null").select("word", "form"))
    return w.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
