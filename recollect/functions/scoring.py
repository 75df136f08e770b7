"""Scores as column expressions: ranking, forgetting and review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import array_jaccard, title_hit, white_words


def by_type(type_: Column, values: dict, other) -> Column:
    out = F.lit(float(other))
    for name, v in values.items():
        out = F.when(type_ == name, float(v)).otherwise(out)
    return out


def age_days(ts: Column, as_of) -> Column:
    return (F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)) / 86_400_000_000.0


def recency(created_at: Column, type_: Column, as_of) -> Column:
    """Halves every half-life of the type; over 1 for dates after as_of."""
    return F.exp(-F.log(F.lit(2.0)) * age_days(created_at, as_of) / by_type(type_, C.HALF_LIFE_DAYS, C.OTHER_HALF_LIFE))


def importance(user: Column, pinned: Column, type_: Column) -> Column:
    raw = user + F.when(pinned, C.PINNED_BOOST).otherwise(0.0) + by_type(type_, C.TYPE_BOOST, 0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def raw_usage(views: Column, cites: Column, edits: Column) -> Column:
    return F.log1p(views.cast("double")) + 2 * F.log1p(cites.cast("double")) + 0.5 * F.log1p(edits.cast("double"))


def usage(views: Column, cites: Column, edits: Column) -> Column:
    raw = raw_usage(views, cites, edits)
    return F.when(raw == 0, 0.1).otherwise(F.least(F.lit(1.0), raw / 10))


def batch_usage(raw: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, 0.5).otherwise((raw - low) / (high - low + 1e-6))


def simple_bm25(query: Column, content: Column, k1: float = 1.2, b: float = 0.75, mean: float = 100.0) -> Column:
    """BM25 with one idf for all words and a fixed mean length, at most 1; repeated query words count again."""
    words = white_words(content)
    norm = k1 * (1 - b + b * F.size(words) / mean)

    def add(total, term):
        tf = F.size(F.filter(words, lambda w: w == term)).cast("double")
        return total + F.when(tf > 0, F.log(F.lit(2.0)) * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)

    score = F.aggregate(white_words(query), F.lit(0.0), add)
    return F.when((query == "") | (content == ""), 0.0).otherwise(F.least(F.lit(1.0), score / 10))


def tag_match(query: Column, tags: Column) -> Column:
    lower = F.transform(tags, lambda t: F.lower(t))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) == 0, 0.0).otherwise(array_jaccard(white_words(query), lower))


def relevance(query: Column, content: Column, tags: Column, title: Column | None = None, cosine: Column | None = None) -> Column:
    out = 0.3 * simple_bm25(query, content) + 0.05 * tag_match(query, tags)
    if cosine is not None:
        out = 0.6 * F.coalesce(cosine, F.lit(0.0)) + out
    if title is not None:
        out = out + 0.05 * F.when(title == "", 0.0).otherwise(title_hit(query, title))
    return F.when((query == "") | (content == ""), 0.0).otherwise(out)


def final_score(rel: Column, rec: Column, imp: Column, use: Column, dup: Column, w: C.RankWeights = C.RankWeights()) -> Column:
    return w.relevance * rel + w.recency * rec + w.importance * imp + w.usage * use - w.duplication * dup


def reasons(*pairs: tuple[Column, str], other) -> Column:
    """The names of the conditions that hold, in order; other if none does."""
    text = F.concat_ws(", ", *[F.when(c, name) for c, name in pairs])
    return F.when(text == "", other if isinstance(other, Column) else F.lit(other)).otherwise(text)


def recall_reason(rel: Column, rec: Column, imp: Column, score: Column) -> Column:
    return reasons((rel > 0.7, "높은 관련성"), (rec > 0.8, "최근 생성"), (imp > 0.8, "높은 중요도"), (score > 0.9, "종합 점수 우수"), other="일반 검색 결과")


def forget_usage(last_accessed: Column, views: Column, cites: Column, edits: Column, as_of) -> Column:
    fresh = F.coalesce(F.exp(-age_days(last_accessed, as_of) / 30), F.lit(0.0))
    return F.greatest(fresh, F.least(F.lit(1.0), raw_usage(views, cites, edits) / 10))


def forget_score(rec: Column, use: Column, dup: Column, imp: Column, pinned: Column, w: C.ForgetWeights = C.ForgetWeights()) -> Column:
    return w.recency * (1 - rec) + w.usage * (1 - use) + w.duplication * dup - w.importance * imp - w.pinned * pinned.cast("double")


def forget_reason(rec: Column, use: Column, dup: Column, imp: Column, pinned: Column, score: Column) -> Column:
    other = F.format_string("망각 점수 높음 (%.3f)", score)
    return reasons((rec < 0.3, "오래된 기억"), (use < 0.2, "사용되지 않음"), (dup > 0.7, "중복도 높음"), (imp < 0.3, "중요도 낮음"), (~pinned, "고정되지 않음"), other=other)


def next_interval(current: Column, imp: Column, use: Column, helpful: Column, bad: Column, w: C.ReviewWeights = C.ReviewWeights()) -> Column:
    grown = current * (1 + w.importance * imp + w.usage * use + w.helpful * helpful - w.bad * bad)
    return F.ceil(F.round(grown, 9)).cast("long")


def recall_probability(days: Column, interval: Column) -> Column:
    return F.exp(-days / interval)


def review_priority(probability: Column, interval: Column) -> Column:
    return (1 - probability) + F.log(interval + 1.0) / 10


def content_importance(content: Column, n_tags: Column, type_: Column) -> Column:
    n = F.length(content)
    raw = F.lit(0.5) + F.when(n > 500, 0.2).when(n > 200, 0.1).when(n < 50, -0.1).otherwise(0.0)
    raw = raw + F.when(n_tags > 5, 0.2).when(n_tags > 2, 0.1).when(n_tags == 0, -0.1).otherwise(0.0)
    raw = raw + F.when(type_ == "semantic", 0.2).when(type_ == "procedural", 0.1).when(type_ == "working", -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0, null if the sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine without negative values; 0 if the sizes differ."""
    return F.greatest(F.lit(0.0), F.coalesce(cosine(a, b), F.lit(0.0)))


def bm25_share(score: Column) -> Column:
    """A BM25 score between 0 and 1."""
    return score / (score + 2.0)


def score_between(score: Column, low: Column, high: Column) -> Column:
    """Where a score lies between two others, from 0 to 1; 0 if they are equal."""
    return F.when(low == high, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low))))


def usage_by_access(last_accessed: Column, as_of) -> Column:
    return F.coalesce(F.exp(-age_days(last_accessed, as_of) / 30), F.lit(0.1))


def first_score(*scores: Column) -> Column:
    """The first score that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in scores], F.lit(0.0))


def shared_weights(vector: Column, text: Column) -> tuple[Column, Column]:
    """Two weights that add up to 1; 0.6 and 0.4 if both are 0."""
    total = vector + text
    return F.when(total > 0, vector / total).otherwise(0.6), F.when(total > 0, text / total).otherwise(0.4)
