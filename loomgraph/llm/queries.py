"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, langid, line_dedup, ngram_join, pieces, pii, resampling, secrets, token_binary, vector_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.matching_lines(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.binary_ids(table(spark, sf_dir, "documents"))


def op9_vector_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_language_spans": op7_language_spans,
    "op8_token_binary": op8_token_binary,
    "op9_vector_near_copies": op9_vector_near_copies,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

ORACLE_SQL = {
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS overlap
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
e AS (SELECT i, j FROM o JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE overlap >= 0.7 * (x.n + y.n - overlap) - 1e-9),
c AS (SELECT DISTINCT i, i AS at FROM e UNION SELECT c.i, e.j FROM c JOIN e ON e.i = c.at)
SELECT l.i AS doc_id, l.class_id, d.links
FROM (SELECT i, min(at) AS class_id FROM c GROUP BY i) l JOIN (SELECT i, count(*) AS links FROM e GROUP BY i) d USING (i)""",
}
