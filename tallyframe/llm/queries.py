"""Registered queries of the subpackage: one per operator, over whole tables,
with production parameters.  ``QUERIES`` and ``ORACLE`` are added to the
catalogue by the driver entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    byte_bpe, fingerprint, hard_negatives, jaccard_join, license_scan, line_dedup, mixing, packing, quality_crf, token_files, toxicity_fm,
    url_filter, word_variants)
from tallyframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses."""
    return fingerprint.edited_pairs(_table(spark, sf_dir, "documents"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line deduplication, as counts and a digest."""
    out = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op2_line_dedup"] = """
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents),
keyed AS (
  SELECT doc_id, n, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM parts),
repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.n, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@_query
def op3_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a machine learnt outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity_fm.score(docs, toxicity_fm.train(docs, _table(spark, sf_dir, "labels")))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-duplicate component of every document."""
    return jaccard_join.linked_documents(_table(spark, sf_dir, "documents"))


@_query
def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the verdict on every document."""
    docs = _table(spark, sf_dir, "documents")
    field = quality_crf.train_field(docs, _table(spark, sf_dir, "labels"))
    return quality_crf.quality_measures(docs, field)


@_query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


ORACLE["op6_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         greatest(0.1::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE
                  * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))
                  / greatest(length(coalesce(text, '')), 1)) AS weight,
         -ln((('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE
              + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS drawn
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sized GROUP BY source),
caps AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / w AS ratio FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE
             - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
            / ((SELECT sum(w) FROM per) - coalesce(sum(w) OVER before, 0.0::DOUBLE)) AS level
  FROM caps
  WINDOW before AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM settled) * w, cap)) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT s.doc_id, s.source, s.size, s.weight, p.source_size, p.target, p.epochs,
         floor(p.target)::BIGINT - p.epochs * p.source_size
         - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.drawn / s.weight, s.doc_id, s.size, s.weight
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, weight, source_size, target,
       CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken
FROM ordered
"""


@_query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices found in all documents, with coverage and spans."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and digested."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.token_digests(token_files.read_tokens(spark, path)).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the byte-level BPE ids of all documents and of the bytes decoded from them."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all vectors."""
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


ORACLE["op13_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, b.r AS br, b.vec_id, b.label,
         CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.c, b.c)]), 0) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT * FROM (
    SELECT ar, anchor_id, al, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST, br) AS place
    FROM scored WHERE label = al AND br <> ar) WHERE place <= 5),
neg AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.br) AS rank
  FROM pos p JOIN scored s ON s.ar = p.ar AND s.label <> p.al
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE rank <= 10
"""


@_query
def op12_word_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all documents."""
    return word_variants.variants(_table(spark, sf_dir, "documents"))


ORACLE["op12_word_variants"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                          b) AS v FROM (SELECT unnest(range(256)) AS b))),
seen AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(
    flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END
             FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM seen, crc_table),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
         CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM formed f JOIN chain c ON f.form = c.word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed JOIN chain USING (word)
"""
