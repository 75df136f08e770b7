"""Token counts through a cache of content digests."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, delete, scratch, stored, text_slices, writing

LIMIT = 2048
CACHE = "digest string, n_tokens bigint"
#: Bound of each worker's memo of words, in entries.
MEMO = 1_000_000
#: Marks that end a word; none is a letter, digit or apostrophe, so the pre-tokenizer parts them from letters before them.
MARKS = ".,;:!?#$%&*|"
#: The separators U+001C to U+001F part words for str.split but are symbols for the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
WORDS = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")

_loaded: dict = {}


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file, which is part of every cache key."""
    with open(path, "rb") as f:
        return xxhash.xxh3_128_hexdigest(f.read())


def _counter(path: str):
    """Function from words to their token counts, memoised for this worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path), {}
    return _loaded[path]


def _plain(word: str) -> bool:
    """Whether word is letters of Latin-1 only: one piece for the pre-tokenizer, whatever stands around it."""
    return word.isalpha() and max(word) <= "\u00ff"


def _encode_words(words: list[str], tokenizer) -> dict[str, int]:
    """Token counts of single words. Plain ones are encoded 200 together, where each is one piece of the encoding."""
    plain, other, found = [], [], {}
    for w in words:
        (plain if _plain(w) else other).append(w)
    groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
    for group, e in zip(groups, tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        per_piece = Counter(e.word_ids)
        if len(per_piece) == len(group):
            found.update(zip(group, (per_piece[i] for i in sorted(per_piece)), strict=True))
        else:
            other += group
    found.update(zip(other, map(len, tokenizer.encode_batch_fast(other, add_special_tokens=False)), strict=True))
    return found


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Token counts as the library gives them for whole texts.

    This tokenizer's normaliser and pre-tokenizer drop white space and no token spans it, so a text's count is
    the sum over its words; each different word is encoded once per worker and while the memo lasts. Marks
    after letters are pieces of their own, so a word's letters and its marks are counted apart.
    """
    tokenizer, memo = _counter(path)
    words = [WORDS.findall(t) if SEPARATORS.search(t) else t.split() for t in texts]
    every = set().union(*words) if words else set()
    if len(memo) + len(every) > MEMO:
        memo.clear()
    fresh, parts = set(), {}
    for w in every:
        if w not in memo:
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and stem and _plain(stem):
                parts[w] = stem, w[len(stem) :]
                fresh.update(parts[w])
            else:
                fresh.add(w)
    fresh = [w for w in fresh if w not in memo]
    if fresh:
        memo.update(_encode_words(fresh, tokenizer))
    for w, (stem, marks) in parts.items():
        memo[w] = memo[stem] + memo[marks]
    get = memo.__getitem__
    return [sum(map(get, own)) for own in words]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2 << 20):
            counts = count_tokens(part.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


class TokenCache:
    """digest, n_tokens of all contents counted so far, as Parquet that is only appended to."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "token-cache")
        spark.createDataFrame([], CACHE).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(CACHE).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: TokenCache | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    The cache's key is a digest of the text with white space collapsed (which can't change a count) and of the
    tokenizer file. One text of each digest that the cache lacks is encoded and the counts are appended; every
    row then looks its count up. Null text is empty: 0 bytes and tokens. Rows that repeat a doc_id or a text get a row each.
    A long text is encoded whole in one task. Columns but doc_id and text are not read, so their names can't clash. A cache
    made here is deleted once the counts are written out.
    """
    spark = docs.sparkSession
    own = cache is None
    cache = cache or TokenCache(spark)
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.md5(F.concat(F.lit(version), F.regexp_replace(text, SPACE, " ")).cast("binary")).alias("digest"))
    rows = stored(d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-rows")
    misses = d.select("digest", "text").join(cache.read(), "digest", "left_anti").dropDuplicates(["digest"])
    with writing(spark):
        cache.append(misses.mapInArrow(_encode(tokenizer_path), CACHE))
    # Written out, so that both sides of the join below are plain exchanges and a hot digest's rows can be split.
    counts = stored(cache.read().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    if own:
        delete(spark, cache.path)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
