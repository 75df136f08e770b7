"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontam import contaminated
from .exact import exact_dedup
from .langid import language_id
from .lines import line_dedup
from .mixing import label_weights, mix
from .ngramjoin import ngram_jaccard_join
from .quality import quality_scores
from .simhash import simhash_dedup
from .spelling import spelling_variants
from .substring import substring_dedup
from .suffix import suffix_dedup
from .tokens import token_counts
from .whitening import whitening


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(documents(spark, sf_dir), weights).drop("source").withColumn("target", F.round("target", 4))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict:
    every = (
        op1_simhash_dedup,
        op2_token_counts,
        op3_language_id,
        op4_suffix_dedup,
        op5_substring_dedup,
        op6_quality,
        op7_exact_dedup,
        op8_decontaminate,
        op9_line_dedup,
        op10_mix_sources,
        op11_ngram_jaccard_join,
        op12_spelling_variants,
        op13_whitening,
    )
    return {f.__name__: f for f in every}


OP7 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT doc_id, i, line, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: The targets come from at most one round for each source; the sample's prefix sums are plain windows here.
OP10 = r"""
WITH RECURSIVE q AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.5 END)::DOUBLE AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size,
    round(pow((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0, 1.0 / coalesce(weight, 1.0)), 12) AS key
  FROM documents LEFT JOIN q USING (doc_id)
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source
), t AS (
  SELECT 0 AS round, source, source_size, weight, NULL::DOUBLE AS fixed FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, fixed FROM (
    SELECT round, source, source_size, weight, total, changed, CASE WHEN fixed IS NULL AND 3 * source_size <= share * weight THEN 3 * source_size ELSE fixed END AS fixed FROM (
      SELECT *, bool_or(fixed IS NULL AND 3 * source_size <= share * weight) OVER () AS changed FROM (
        SELECT *, sum(source_size) OVER () AS total, (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) / sum(weight) FILTER (fixed IS NULL) OVER () AS share FROM t
      )
    ) WHERE changed
  )
), u AS (
  SELECT source, source_size, coalesce(fixed, (sum(source_size) OVER () - coalesce(sum(fixed) OVER (), 0)) / sum(weight) FILTER (fixed IS NULL) OVER () * weight) AS target
  FROM t WHERE round = (SELECT max(round) FROM t)
), v AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM u
), x AS (
  SELECT d.*, v.source_size, v.target, v.epochs, floor(v.target + 1e-6)::BIGINT - v.epochs * v.source_size::BIGINT AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 4) AS target,
  (epochs * size + greatest(0, least(size, rest - used)))::BIGINT AS taken FROM x
"""


OP11 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), e AS MATERIALIZED (
  SELECT doc_id, x FROM (SELECT doc_id, unnest(s) AS x FROM s) QUALIFY count(*) OVER (PARTITION BY x) > 1
), p AS MATERIALIZED (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2) JOIN (SELECT doc_id AS a, len(s) AS la FROM s) USING (a) JOIN (SELECT doc_id AS b, len(s) AS lb FROM s) USING (b)
  WHERE 100 * n >= 80 * (la + lb - n)
), r AS (
  SELECT doc_id, doc_id AS other FROM s
  UNION SELECT r.doc_id, l.b FROM r JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) l ON r.other = l.a
)
SELECT doc_id, any_value(len(s))::BIGINT AS n_shingles, min(other) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id
"""

#: CRC-32 byte by byte from its polynomial; near words share what is left without one code point, at the same place or as a word.
OP12 = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents)
), h AS (
  SELECT low, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT low, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || low)) AS x FROM low), t
), v AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(low, 1, (h % length(low))::BIGINT) || substr(low, (h % length(low))::BIGINT + 2) ELSE low END AS word FROM h) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), d AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest
), f AS MATERIALIZED (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN (
    SELECT near.word, other, v.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN v ON v.word = other QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) = 1) USING (word)
), r AS (
  SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM r WHERE next IS NULL) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7, "op9_line_dedup": OP9, "op10_mix_sources": OP10, "op11_ngram_jaccard_join": OP11, "op12_spelling_variants": OP12}
