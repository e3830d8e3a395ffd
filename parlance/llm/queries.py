"""The registered queries of the training-data operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import chat, embeddings, language_id, minhash, mixing, packing, quality_classifier, quality_rules, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str, str]:
    """The default vocabulary: the `tokenizers` file, its rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(_table(spark, sf_dir, "documents"), window=13)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3, seed=0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *tokenizer_files())


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_chat": op4_chat,
    "op5_packing": op5_packing,
    "op6_embeddings": op6_embeddings,
    "op7_warc": op7_warc,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash": op10_minhash,
    "pipeline": pipeline,
}

MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || doc_id) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ordered AS (  -- by how soon a source is clamped
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
cumulated AS (
  SELECT *, CAST(coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS clamped,
         CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS free FROM ordered),
level AS (  -- the first k whose source isn't clamped
  SELECT clamped, free, k FROM cumulated WHERE (total - clamped) * weight <= 3 * source_size * free ORDER BY k LIMIT 1),
targets AS (
  SELECT o.source, o.source_size, CASE WHEN o.k < l.k THEN CAST(3 * o.source_size AS DOUBLE)
         ELSE CAST(o.total - l.clamped AS DOUBLE) * o.weight / CAST(l.free AS DOUBLE) END AS target
  FROM ordered o, level l),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) % source_size ELSE 0 END AS rest FROM targets),
placed AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized d)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken
FROM placed d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
"""

# Cosines in double precision, components by repeated smallest neighbours.
EMBEDDINGS_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (
  SELECT * FROM vectors
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS id, vec_id AS low FROM vectors
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id AND r.low < l.b)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, r.low AS component_id, v.vec_id = r.low AS kept
FROM vectors v JOIN (SELECT id, min(low) AS low FROM reach GROUP BY id) r ON r.id = v.vec_id
"""

SUBSTRINGS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS key FROM d, unnest(range(0, greatest(len(w) - 12, 0))) AS r(i)),
firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM windows JOIN firsts USING (key), unnest(range(0, 13)) AS t(j) WHERE first < doc_id),
words AS (SELECT doc_id, w[i + 1] AS word, i AS pos FROM d, unnest(range(0, len(w))) AS r(i)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.pos = w.pos) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM l
"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS item FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT doc_id AS id, doc_id AS low FROM sizes
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.id AND r.low < l.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.low AS component_id, s.doc_id = r.low AS kept
FROM sizes s JOIN (SELECT id, min(low) AS low FROM reach GROUP BY id) r ON r.id = s.doc_id
"""

ORACLES: dict[str, str] = {
    "op1_substrings": SUBSTRINGS_SQL,
    "op2_mixing": MIXING_SQL,
    "op6_embeddings": EMBEDDINGS_SQL,
    "op7_warc": WARC_SQL,
    "op10_minhash": NEAR_SQL,
}
