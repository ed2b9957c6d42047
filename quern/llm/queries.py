"""One query for each operator, over its whole table, and the SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quern.llm import bpe, decontaminate, exact_dedup, licences, ngram_join, ngram_lm, suffix_dedup, toxicity, warc, wrappers
from quern.llm.common import read_table


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(read_table(spark, sf_dir, "pages"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(read_table(spark, sf_dir, "documents"))


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(read_table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(read_table(spark, sf_dir, "documents")).drop("kept")


OP6_SQL = """
WITH bodies AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM bodies WHERE n >= 50)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first_id FROM strings) WHERE first_id < doc_id),
marked AS (SELECT *, coalesce(p > lag(p) OVER w + 50, true) AS fresh FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
pieces AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS start FROM runs),
cut AS (SELECT b.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (lo - start)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept, sum(hi - lo) AS removed, count(*) AS n_spans FROM pieces p JOIN bodies b ON b.doc_id = p.doc_id GROUP BY b.doc_id)
SELECT b.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bodies b LEFT JOIN cut c ON c.doc_id = b.doc_id
"""


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "spans")


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def op9_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read_table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
d AS (
  SELECT DISTINCT doc_id, s
  FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (SELECT DISTINCT a AS id, a AS c FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(c) FROM reach WHERE id = t.doc_id), t.doc_id) AS component_id, (SELECT count(*) FROM links WHERE a = t.doc_id) AS n_links
FROM t LEFT JOIN n ON n.doc_id = t.doc_id
"""


def op10_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


OP10_SQL = """
SELECT page_id,
       octet_length(payload) AS payload_bytes,
       sha256(payload) AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM (SELECT page_id, payload,
             CASE WHEN octet_length(payload) >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first_id
      FROM (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_content_sort": op3_content_sort,
    "op4_template_windows": op4_template_windows,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_two_stage_suffixes": op6_two_stage_suffixes,
    "op7_crf_toxicity": op7_crf_toxicity,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_prefix_trie": op9_prefix_trie,
    "op10_warc_normalise": op10_warc_normalise,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_content_sort": OP3_SQL,
    "op6_two_stage_suffixes": OP6_SQL,
    "op9_prefix_trie": OP9_SQL,
    "op10_warc_normalise": OP10_SQL,
}
