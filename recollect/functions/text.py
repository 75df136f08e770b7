"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FORBIDDEN_IN_QUERIES, LONGEST_QUERY, STOP_WORDS, TECHNICAL_QUERIES, TECHNICAL_WORDS, TOOL_CATEGORIES



def _marked() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and the letters that full-text search takes them for."""
    found = {}
    for i in range(0xC0, 0x1F00):
        base, *marks = unicodedata.normalize("NFD", chr(i))
        if len(marks) == 1 and "a" <= base <= "z":
            found[chr(i)] = base
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _marked()
WHITE = r"[ \t\n\r\f\x0B]+"
WORD = "[A-Za-z0-9_가-힣]"


def _array(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def let(x: Column, f) -> Column:
    """f of x, which is evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def counted(words: Column) -> Column:
    """Array of (word, n), in the order of words: how often each is in the array. A row needs no other row for it."""

    def runs(s):
        placed = F.transform(s, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
        return F.filter(placed, lambda x: (x["at"] == 0) | (x["word"] != F.get(s, x["at"] - 1)))

    def each(s):
        ends = lambda r, k: F.coalesce(F.get(r, k + 1)["at"], F.size(s))
        return let(runs(s), lambda r: F.transform(r, lambda x, k: F.struct(x["word"].alias("word"), (ends(r, k) - x["at"]).cast("long").alias("n"))))

    return let(F.sort_array(words), each)


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def search_tokens(text: Column) -> Column:
    """Tokens of full-text search: folded runs of letters and digits."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def clean_query(query: Column, stop_words=STOP_WORDS) -> Column:
    """Query words without punctuation and stop words, joined by spaces; empty if nothing stays."""
    q = F.regexp_replace(F.regexp_replace(F.trim(query), WHITE, " "), "[^a-zA-Z0-9가-힣 ]", " ")
    words = F.filter(F.split(q, " "), lambda w: (w != "") & ~F.array_contains(_array(stop_words), F.lower(w)))
    return F.array_join(words, " ")


def normal_query(query: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(query, WHITE, " ")))


def white_words(text: Column) -> Column:
    return F.split(F.lower(text), WHITE)


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared share of the distinct lower-case words of two texts."""
    return array_jaccard(white_words(a), white_words(b))


def array_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def set_jaccard(a: Column, b: Column) -> Column:
    """array_jaccard of arrays without repeats: one set of them is made instead of two."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def trigrams(text: Column) -> Column:
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, grams).otherwise(F.array().cast("array<string>"))


def title_hit(query: Column, title: Column) -> Column:
    q, t = F.lower(query), F.lower(title)
    return F.when(t == q, 1.0).when(F.startswith(t, q), 0.5).when(F.arrays_overlap(trigrams(q), trigrams(t)), 0.2).otherwise(0.0)


def embedding_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """Tokens of the hashed embedding: lower case, longer than one character, no stop words."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_ \\t\\n\\r\\f\\x0B가-힣]", " "), WHITE)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop_words))


def string_hash(word: Column) -> Column:
    """The 31-multiplier hash of UTF-16 units as a signed 32-bit number, which is the JVM's own hash of a string."""
    return F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), word).cast("long")


def bucket(word: Column, dims: int = 512) -> Column:
    return F.abs(string_hash(word)) % dims


def hash_base36(text: Column) -> Column:
    return F.lower(F.conv(F.abs(string_hash(text)).cast("string"), 10, 36))


def word_idf(word: Column) -> Column:
    """Heuristic inverse document frequency from a word's length and kind."""
    n = F.length(word)
    idf = F.lit(1.0) + F.when(n > 5, 0.5).otherwise(0.0) + F.when(n > 8, 0.3).otherwise(0.0)
    idf = idf - F.when(word.rlike("[0-9]"), 0.2).otherwise(0.0) + F.when(word.rlike("[^a-zA-Z가-힣]"), 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.1), idf)


def keyword_factor(word: Column, times: Column) -> Column:
    """Factor for each occurrence of a word: the last rule that holds wins."""
    caseless = word.rlike("^[0-9_가-힣]") & (F.length(word) > 2)
    return F.when(times > 3, 0.8).when(caseless, 1.3).when(word.rlike(TECHNICAL_WORDS), 1.5).otherwise(1.0)


def word_facts(words: pa.Array, dims: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket, word_idf and the logarithm of keyword_factor (for up to three times) of tokens of the hashed embedding, for
    tasks that take texts as arrays. Such tokens are not empty and have no character beyond 16 bits."""
    n = pc.utf8_length(words).to_numpy().astype(np.int64)
    has = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    units = np.frombuffer("".join(words.to_pylist()).encode("utf-16-le"), np.uint16).astype(np.uint32)
    powers = np.full(n.max(initial=1), 31, np.uint32)
    powers[0] = 1
    ends = np.cumsum(n)
    h = np.add.reduceat(units * np.multiply.accumulate(powers)[np.repeat(ends, n) - 1 - np.arange(len(units))], ends - n)
    h = (h & 0xFFFFFFFF).astype(np.int64)  # whatever the sums' width, which wraps, these bits are right
    idf = 1.0 + np.where(n > 5, 0.5, 0.0) + np.where(n > 8, 0.3, 0.0)
    idf = idf - np.where(has("[0-9]"), 0.2, 0.0) + np.where(has("[^a-zA-Z가-힣]"), 0.3, 0.0)
    factor = np.where(has("^[0-9_가-힣]") & (n > 2), 1.3, np.where(has(TECHNICAL_WORDS), 1.5, 1.0))
    return np.minimum(h, 2**32 - h) % dims, np.maximum(0.1, idf), np.log(factor)


def is_technical_query(query: Column) -> Column:
    return normal_query(query).rlike(f"^({TECHNICAL_QUERIES})$")


def quarter_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def mixed_tokens(text: Column) -> Column:
    """Hangul characters, 1.3 per Latin word, and every other character."""
    hangul = F.length(text) - F.length(F.regexp_replace(text, "[가-힣]", ""))
    latin = F.length(text) - F.length(F.regexp_replace(text, "[a-zA-Z]", ""))
    words = F.size(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)))
    return (hangul + F.ceil(F.round(words * 1.3, 9)) + F.length(text) - hangul - latin).cast("long")


def extracted_tags(text: Column) -> Column:
    """#tags, @mentions and words before a colon, in this order, repeats included."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (f"#({WORD}+)", f"@({WORD}+)", f"({WORD}+):")]
    return F.concat(*found)


def summary(text: Column, most: int = 200) -> Column:
    """Whole sentences up to a length, each ended by a full stop; else the first characters."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("over"))

    def step(s, sentence):
        fits = ~s["over"] & (F.length(s["out"]) + F.length(sentence) <= most)
        return F.struct(F.when(fits, F.concat(s["out"], sentence, F.lit("."))).otherwise(s["out"]).alias("out"), (~fits).alias("over"))

    out = F.aggregate(F.split(text, "[.!?]+"), start, step, lambda s: s["out"])
    return F.when(F.length(text) <= most, text).when(out != "", out).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def budget_summary(text: Column, tokens: Column) -> Column:
    """First, middle and last words of a text that fit a token budget."""
    most = F.floor(F.round(tokens / 1.5, 9)).cast("int")
    # No more words are split off than are looked at.
    words = F.split(text, " ", F.greatest(most, F.lit(0)) + 2)
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(r"[^ \t\n\r\f\x0B]"))
    strip = lambda s: F.regexp_replace(s, r"^[ \t\n\r]+|[ \t\n\r]+$", "")

    def long(s):
        return let(
            F.struct(s.alias("s"), strip(F.element_at(s, 1)).alias("first"), strip(F.element_at(s, -1)).alias("last")),
            lambda x: let(F.struct(x["s"].alias("s"), x["first"].alias("first"), x["last"].alias("last"), (most - F.size(F.split(x["first"], " "))).alias("rest"), F.size(F.split(x["last"], " ")).alias("n_last")), ended),
        )

    def ended(x):
        n, rest = F.size(x["s"]), x["rest"]
        inner = F.array_join(F.slice(x["s"], F.lit(2), F.greatest(n - 2, F.lit(0))), ". ")
        middle = F.when((rest > 0) & (n > 2), F.slice(F.split(inner, " ", F.greatest(rest, F.lit(0)) + 2), F.lit(1), F.greatest(rest - x["n_last"], F.lit(0))))
        return let(F.coalesce(middle, F.array().cast("array<string>")), lambda m: F.concat(
            x["first"],
            F.when(F.size(m) > 0, F.concat(F.lit(" "), F.array_join(m, " "))).otherwise(""),
            F.when(rest - F.size(m) > 0, F.concat(F.lit(" "), x["last"])).otherwise(""),
        ))

    def cut(s):
        dotted = let(long(s), lambda x: F.concat(x, F.when(F.length(x) < F.length(text), "...").otherwise("")))
        return F.when(F.size(s) > 2, dotted)

    short = let(words, lambda w: F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, F.lit(1), F.greatest(most, F.lit(0))), " "), F.lit("..."))))
    return let(short, lambda x: F.when(x.isNull(), text).otherwise(F.coalesce(let(sentences, cut), x)))


def relative_time(ts: Column, as_of) -> Column:
    seconds = F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)
    parts = [(F.floor(seconds / (u * 1e6)), name) for u, name in ((86400, "일 전"), (3600, "시간 전"), (60, "분 전"))]
    out = F.lit("방금 전")
    for n, name in reversed(parts):
        out = F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(out)
    return out


def format_bytes(n: Column) -> Column:
    """1536 as 1.5 KB: two decimals at most, trailing zeros dropped."""
    power = F.when(n > 0, F.floor(F.log(n) / F.log(F.lit(1024.0)))).otherwise(0).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    unit = F.element_at(_array(["B", "KB", "MB", "GB", "TB"]), power + 1)
    return F.when(n == 0, "0 B").otherwise(F.concat_ws(" ", shown, unit))


def query_complexity(sql: Column) -> Column:
    n = F.lit(0)
    for word, points in (("JOIN", 2), ("GROUP BY", 1), ("ORDER BY", 1), ("HAVING", 1), ("UNION", 2)):
        n = n + F.when(F.contains(sql, F.lit(word)), points).otherwise(0)
    n = n + F.when(F.size(F.regexp_extract_all(sql, F.lit("SELECT"), F.lit(0))) > 1, 2).otherwise(0)
    return F.when(n <= 1, "simple").when(n <= 3, "medium").otherwise("complex")


def query_error(query: Column) -> Column:
    """empty, too_long or forbidden; null for a query that may be asked."""
    bad = F.lit(False)
    for p in FORBIDDEN_IN_QUERIES:
        bad = bad | query.rlike(f"(?i){p}")
    blank = query.isNull() | (F.regexp_replace(query, WHITE, "") == "")
    return F.when(blank, "empty").when(F.length(query) > LONGEST_QUERY, "too_long").when(bad, "forbidden")


def truncated(text: Column, tokens: int = 8191) -> Column:
    """A text's first 4 characters a token."""
    return F.substring(text, 1, 4 * tokens)


def tool_category(name: Column) -> Column:
    out = F.lit("other")
    for parts, category in reversed(TOOL_CATEGORIES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(name, F.lit(p))
        out = F.when(hit, category).otherwise(out)
    return out


def parsed_tags(text: Column) -> Column:
    """Tags from their JSON text; an empty list where it is null or no list of texts."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
