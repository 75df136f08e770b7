"""Jaccard join of five-word shingle sets: prefix filters under several token orders, verified, then connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, stored, text_bytes, text_slices, texts
from .components import components
from .repeats import mix, ranges, runs
from .shingles import SHINGLE, shingles
from .simhash import _forest

#: Sets link if PART * intersection >= LIMIT * union.
PART, LIMIT = 100, 80
#: Token orders: rarest first in each, tokens of one frequency by an own permutation.
ORDERS = 3
#: Shingles that one task counts at once.
COUNTED = 1 << 22
#: Bytes of a token on its way, and compressed bytes of text worked on at once.
WIDTH, SLICE = 6, 1 << 20
#: Bits of the largest sketch of a set.
SKETCH = 1 << 15
#: Sets compared with each other in one piece of work; larger buckets are dealt out as pairs of chunks.
CHUNK = 512
#: Columns of a dense table of sets and tokens.
COLUMNS = 4096


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many first tokens of a set, in any order, meet the first ones of every set that it links with."""
    return n - -(-LIMIT * n // PART) + 1


def permuted(tokens: np.ndarray, order: int) -> np.ndarray:
    """What orders tokens of one frequency in an order."""
    return mix(tokens ^ mix(np.array([order + 1], np.uint64)))


def _digested(k: int):
    """doc_id, row, text (compressed), h1, h2 (128 bits of the set; 0, 0 of an empty one) and n_shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for part in text_slices(batches):
            bodies = texts(part.column("text"))
            sets, at = shingles(bodies, k)
            packed = pa.array([small.compress(b) for b in bodies], pa.binary())
            h = [xxhash.xxh3_128_intdigest(sets[a:b].tobytes()) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)]
            h1, h2 = (pa.array(np.array([x >> s & (2**64 - 1) for x in h], np.uint64).view(np.int64)) for s in (64, 0))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), packed, h1, h2, pa.array(np.diff(at))], ["doc_id", "row", "text", "h1", "h2", "n_shingles"])

    return run


def _dealt(k: int, buckets: int):
    """From rows (key, text) the tokens by bucket, packed: bucket, keys and sizes of the sets, tokens, and the set of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = zstandard.ZstdDecompressor()
        for part in text_slices(batches, SLICE):
            sets, at = shingles([large.decompress(b) for b in texts(part.column("text"))], k)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
            bucket = (mix(sets) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, sets, owner = bucket[order], sets[order], owner[order]
            first, ends = runs(bucket)
            keys = part.column("key").to_numpy()
            rows: list[list] = [[], [], [], [], []]
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                own, place = np.unique(owner[a:b], return_inverse=True)
                for column, x in zip(rows, (bucket[a], keys[own], n[own], packed(sets[a:b]), place.astype(np.int32)), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["bucket", "keys", "sizes", "tokens", "owner"])

    return run


def packed(tokens: np.ndarray) -> bytes:
    """The low WIDTH bytes of each token; the high ones are known from the bucket but for a few bits, which nothing needs."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(col: pa.Array) -> np.ndarray:
    """The tokens of all rows end to end."""
    data, _ = text_bytes(col)
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = data.reshape(-1, WIDTH)
    return out.reshape(-1).view(np.int64)


def groups_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each group of equal values of names, from batches in which groups are whole and in a row."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        place = np.stack([t.column(c).to_numpy() for c in names], 1)
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1)])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(int(starts[-1]))
    if rest is not None and len(rest):
        yield rest


def _counted(parts: int):
    """From the rows of buckets the tokens that two sets hold at least, packed again by the sets' parts: part, keys, sizes,
    tokens, how many sets hold each (df), and the set of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, ("bucket",)):
            keys, sizes, tokens, owner = (t.column(c).combine_chunks() for c in ("keys", "sizes", "tokens", "owner"))
            shift = np.r_[0, np.cumsum(np.diff(keys.offsets.to_numpy()))][:-1]
            lengths = np.diff(owner.offsets.to_numpy())
            place = owner.flatten().to_numpy() + np.repeat(shift, lengths)
            key, size = keys.flatten().to_numpy()[place], sizes.flatten().to_numpy()[place]
            token = unpacked(tokens)
            order = np.argsort(token, kind="stable")
            token, key, size = token[order], key[order], size[order]
            first, ends = runs(token)
            df = np.repeat(ends - first, ends - first)
            some = df > 1
            token, key, size, df = token[some], key[some], size[some], df[some]
            part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key, part))
            token, key, size, df, part = token[order], key[order], size[order], df[order], part[order]
            first, ends = runs(part)
            rows: list[list] = [[], [], [], [], [], []]
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                own, at, place = np.unique(key[a:b], return_index=True, return_inverse=True)
                for column, x in zip(rows, (part[a], own, size[a:b][at], token[a:b], df[a:b], place.astype(np.int32)), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(rows, types, strict=True)], ["part", "keys", "sizes", "tokens", "df", "owner"])

    return run


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each token, at a place that its hash says, of twice as many bits as tokens or more (SKETCH at most), packed."""
    bits = min(SKETCH, max(8, 1 << int(2 * len(tokens) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(mix(tokens) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the rows of parts: key, size, tokens (those that other sets hold too, sorted) and the prefix of each order, of
    every set whose prefixes are not made of tokens of its own alone."""
    for t in groups_of(batches, ("part",)):
        keys, sizes, tokens, df, owner = (t.column(c).combine_chunks() for c in ("keys", "sizes", "tokens", "df", "owner"))
        shift = np.r_[0, np.cumsum(np.diff(keys.offsets.to_numpy()))][:-1]
        place = owner.flatten().to_numpy() + np.repeat(shift, np.diff(owner.offsets.to_numpy()))
        key, size = keys.flatten().to_numpy()[place], sizes.flatten().to_numpy()[place]
        token, df = tokens.flatten().to_numpy().view(np.uint64), df.flatten().to_numpy()
        order = np.lexsort((token, key))
        key, size, token, df = key[order], size[order], token[order], df[order]
        first, ends = runs(key)
        held, own = ends - first, size[first]
        # Tokens of the set alone come first in every order and meet nothing.
        left = prefix_length(own) - (own - held)
        fine = np.flatnonzero(left > 0)
        if not len(fine):
            continue
        at = ranges(first[fine], first[fine] + held[fine])
        held, left = held[fine], np.minimum(left[fine], held[fine])
        key, token, df = key[at], token[at], df[at]
        owner = np.repeat(np.arange(len(fine)), held)
        start = np.cumsum(held) - held
        columns = [pa.array(key[start]), pa.array(own[fine]), _lists(token, held)]
        columns.append(pa.array([sketch(token[a : a + n]) for a, n in zip(start.tolist(), held.tolist(), strict=True)], pa.binary()))
        for k in range(ORDERS):
            order = np.lexsort((permuted(token, k), df, owner))
            columns.append(_lists(token[order][ranges(start, start + left)], left))
        yield pa.RecordBatch.from_arrays(columns, ["key", "size", "tokens", "sketch", *(f"p{k}" for k in range(ORDERS))])


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values.view(np.int64)))


SETS = "key bigint, size bigint, tokens array<bigint>, sketch binary, " + ", ".join(f"p{k} array<bigint>" for k in range(ORDERS))


def shared_sets(texts_: DataFrame, total: int, k: int, counted: int = COUNTED) -> DataFrame:
    """key, size, tokens, p0, p1, ... of the sets of texts_ (key, text; total shingles in all) that may link with another."""
    spark = texts_.sparkSession
    buckets = max(1, -(-total // counted))
    n = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = n
    packed = texts_.mapInArrow(_dealt(k, max(buckets, n)), "bucket bigint, keys array<bigint>, sizes array<bigint>, tokens binary, owner array<int>")
    packed = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    back = packed.mapInArrow(_counted(parts), "part bigint, keys array<bigint>, sizes array<bigint>, tokens array<bigint>, df array<bigint>, owner array<int>")
    back = back.repartition(n, "part").sortWithinPartitions("part")
    return back.mapInArrow(_filtered, SETS)


def _overlaps(values: pa.ListArray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values each list of a shares with each list of b (numbers of rows of values, which has n)."""
    flat, at = values.flatten().to_numpy(), values.offsets.to_numpy()
    row = np.repeat(np.arange(n), np.diff(at))
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[column]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)), np.int64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        here = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        table = np.zeros((n, int(column[here][-1]) - low + 1), np.float32)
        table[row[here], column[here] - low] = 1
        both += (table[a] @ table[b].T).astype(np.int64)
    return both


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of both sides of a piece (of side 0 alone, twice, where it is the only one), and which pairs are of different
    components and near enough in size to link."""
    side, size, root = (t.column(c).to_numpy() for c in ("side", "size", "root"))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = b if len(b) else a
    near = PART * np.minimum(size[a][:, None], size[b][None, :]) >= LIMIT * np.maximum(size[a][:, None], size[b][None, :])
    return a, b, near & (root[a][:, None] != root[b][None, :])


def possible(t: pa.Table) -> np.ndarray:
    """Rows of a piece that the sketches let link with another of it.

    A set has at least as many tokens that another lacks as its sketch has bits that the other's lacks, if both are folded
    to one length. Sets that link have nearly as many tokens that others hold too, so their sketches are of one length or of
    neighbouring ones.
    """
    a, b, near = _sides(t)
    if not near.any():
        return a[:0]
    size, held = t.column("size").to_numpy(), t.column("held").to_numpy().astype(np.int64)
    data, at = text_bytes(t.column("sketch").combine_chunks())
    length = np.diff(at)
    found = np.zeros_like(near)
    for n in np.unique(length).tolist():
        i, j = (np.flatnonzero((length[x] == n) | (length[x] == 2 * n)) for x in (a, b))
        if not len(i) or not len(j):
            continue
        tables = []
        for rows in (a[i], b[j]):
            bits = np.zeros((len(rows), 8 * n), bool)
            for k, r in enumerate(rows.tolist()):
                own = np.unpackbits(data[at[r] : at[r + 1]])
                bits[k] = own if len(own) == 8 * n else own[: 8 * n] | own[8 * n :]
            tables.append(bits.astype(np.float32))
        both = tables[0] @ tables[1].T
        most = np.minimum((held[a[i]] - tables[0].sum(1))[:, None], (held[b[j]] - tables[1].sum(1))[None, :]) + both
        fine = most * (PART + LIMIT) >= LIMIT * (size[a[i]][:, None] + size[b[j]][None, :])
        fine &= np.minimum(length[a[i]][:, None], length[b[j]][None, :]) == n
        found[np.ix_(i, j)] |= fine
    found &= near
    return np.unique(np.r_[a[found.any(1)], b[found.any(0)]])


def linked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a piece, one of each side (or of side 0 where it is the only one), whose sets link.

    The pairs that share a prefix token under every order are the candidates; the sets of these alone are compared.
    """
    a, b, near = _sides(t)
    size = t.column("size").to_numpy()
    for k in range(ORDERS):
        if not near.any():
            return a[:0], a[:0]
        near &= _overlaps(t.column(f"p{k}").combine_chunks(), len(t), a, b) > 0
    i, j = np.nonzero(near)
    if not len(i):
        return a[:0], a[:0]
    tokens = t.column("tokens").combine_chunks()
    rows_a, rows_b = np.unique(i), np.unique(j)
    both = _overlaps(tokens, len(t), a[rows_a], b[rows_b])[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)]
    fine = both * (PART + LIMIT) >= LIMIT * (size[a[i]] + size[b[j]])
    return a[i[fine]], b[j[fine]]


PIECE = "bucket bigint, x bigint, y bigint, side int, root bigint, key bigint"


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of pieces (with size, held and sketch) that may link within their piece."""
    for t in groups_of(batches, ("bucket", "x", "y")):
        rows = possible(t)
        if len(rows):
            yield from t.select(["bucket", "x", "y", "side", "root", "key"]).take(pa.array(rows)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (bucket, x, y, side, root, key, size, tokens, p0, ...), a piece all in one partition and in order, a link
    (src, dst) from each set to the first that it reaches within its piece."""
    for t in groups_of(batches, ("bucket", "x", "y")):
        t = t.combine_chunks()
        key = t.column("key").to_numpy()
        root = _forest(len(t), *linked(t))
        moved = np.flatnonzero(root != np.arange(len(t)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[root[moved]])], ["src", "dst"])


def _compared(pieces: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links of pieces (bucket, x, y, side, root, key). Sketches, a fiftieth of the sets, go out first; the sets
    themselves to those rows only that may link by them."""
    p = stored(pieces, f"{name}-pieces")
    order = ("bucket", "x", "y", "side", "key")
    brief = sets.select("key", "size", F.size("tokens").alias("held"), "sketch")
    some = p.hint("merge").join(brief, "key").repartition("bucket", "x", "y").sortWithinPartitions(*order)
    some = stored(some.mapInArrow(_possible, PIECE), f"{name}-possible")
    full = some.hint("merge").join(sets.drop("sketch"), "key").repartition("bucket", "x", "y").sortWithinPartitions(*order)
    out = stored(full.mapInArrow(_links, "src bigint, dst bigint").distinct(), f"{name}-links")
    finished(p, some)
    return out


def leader_pieces(index: DataFrame, chunk: int) -> DataFrame:
    """Pieces in which the first set of each bucket of the index (token, key, size) meets the bucket's other sets."""
    first = index.groupBy("token").agg(F.min(F.struct("key", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = F.lit(PART) * F.least("size", F.col("first.size")) >= F.lit(LIMIT) * F.greatest("size", F.col("first.size"))
    pairs = index.join(first.select("token", "first"), "token").where((F.col("key") != F.col("first.key")) & near)
    pairs = stored(pairs.select(F.col("first.key").alias("bucket"), "key").distinct(), "leader-pairs")
    parts = pairs.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    zero = F.lit(0).cast("long")
    leaders = parts.select("bucket", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("x"), zero.alias("y"), F.lit(0).alias("side"), F.col("bucket").alias("root"), F.col("bucket").alias("key"))
    others = pairs.join(parts, "bucket").select("bucket", F.pmod(F.xxhash64("key"), F.col("parts")).alias("x"), zero.alias("y"), F.lit(1).alias("side"), F.col("key").alias("root"), "key")
    return leaders.unionByName(others)


def rest_pieces(index: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """Pieces for the pairs that the leaders did not join: sets of one bucket in different components.

    roots: node, root. A bucket's sets in the component of its first set (group 0) meet those outside it (group 1) only,
    and these each other; buckets whose sets are all in one component are gone, and so are buckets with the sets of another.
    """
    named = index.join(roots.withColumnRenamed("node", "key"), "key", "left").select("token", "key", F.coalesce("root", "key").alias("root"))
    named = stored(named, "named")
    b = named.groupBy("token").agg(F.min(F.struct("key", "root")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("sets"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum")).where("low <> high")
    b = stored(b.groupBy("n", "sets", "sum").agg(F.min("token").alias("token"), F.first("first.root").alias("home")), "buckets")
    rows = stored(named.join(b.select("token", "home"), "token").select("token", "key", "root", (F.col("root") != F.col("home")).cast("int").alias("own")), "rest")
    parts = rows.groupBy("token").agg(*[F.ceil(F.count_if(F.col("own") == g) / chunk).alias(f"parts{g}") for g in (0, 1)])
    r = rows.join(parts, "token").withColumn("at", F.pmod(F.xxhash64("key"), F.when(F.col("own") == 0, F.col("parts0")).otherwise(F.col("parts1"))))
    zero = F.lit(0).cast("long")
    upto = lambda c: F.sequence(zero, F.col(c) - 1)
    # x from 0: chunks of group 0; below 0: chunks of group 1. y: always a chunk of group 1.
    home = r.where("own = 0").select("token", F.col("at").alias("x"), F.explode(upto("parts1")).alias("y"), F.lit(0).alias("side"), "root", "key")
    met = r.where("own = 1 and parts0 > 0").select("token", F.explode(upto("parts0")).alias("x"), F.col("at").alias("y"), F.lit(1).alias("side"), "root", "key")
    outer = r.where("own = 1").withColumn("other", F.explode(upto("parts1")))
    outer = outer.select("token", (-1 - F.least("at", "other")).alias("x"), F.greatest("at", "other").alias("y"), (F.col("at") > F.col("other")).cast("int").alias("side"), "root", "key")
    out = stored(home.unionByName(met).unionByName(outer).withColumnRenamed("token", "bucket"), "rest-rows")
    finished(named, b, rows)
    return out


def ngram_jaccard_join(docs: DataFrame, k: int = SHINGLE, chunk: int = CHUNK, counted: int = COUNTED) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A text's set is its different shingles of k words (A-Z lower-cased), of a shorter text all its words as one; sets
    link if PART * intersection >= LIMIT * union. component_id is the smallest doc_id that links lead to; equal sets
    link, so rows with equal texts or doc_ids are treated as rows of their own. A null or blank text has an empty set, which
    links with nothing, not even another empty one. A null doc_id names no component unless its component has no
    other. A very long text is one piece of work. An empty table gives no row; other columns are not read.

    Equal sets are one. Tokens are hashes of shingles, of which 48 bits are compared. Tokens that no other set holds drop out once they are counted; what
    is left of a set goes into buckets by its prefix tokens under the first order. In each bucket the first set is
    compared with all others; then sets of one bucket that are in different components still, with each other. Every
    comparison drops what its sketches rule out, takes pairs that share a prefix token under all orders and verifies
    them on the sets.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    d = stored(d.mapInArrow(_digested(k), "doc_id bigint, row bigint, text binary, h1 bigint, h2 bigint, n_shingles bigint"), "digested")
    groups = d.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("row").alias("key"), F.min("doc_id").alias("owner"), F.max("n_shingles").alias("n"))
    groups = stored(groups, "sets")
    total = groups.agg(F.sum("n")).first()[0] or 0
    own = d.select(F.col("row").alias("key"), "text").hint("merge").join(groups.select("key"), "key", "left_semi")
    sets = stored(shared_sets(own, int(total), k, counted), "prefixes")
    index = stored(sets.select(F.explode("p0").alias("token"), "key", "size"), "index")
    first = _compared(leader_pieces(index, chunk), sets, "leader")
    roots = stored(components(first), "roots")
    pieces = rest_pieces(index, roots, chunk)
    rest = _compared(pieces, sets, "rest")
    finished(pieces, index, sets)
    roots = stored(components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionByName(rest)), "roots")
    named = groups.join(roots, groups.key == F.col("node"), "left").select("h1", "h2", "owner", F.coalesce("root", "key").alias("root"))
    owners = named.groupBy("root").agg(F.min("owner").alias("component_id"))
    named = stored(named.join(owners, "root").select("h1", "h2", "component_id"), "named")
    finished(first, rest, groups)
    some = d.where("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    return some.unionByName(d.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
