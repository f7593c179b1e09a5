"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .decontam import find_contamination
from .fingerprint import fingerprint_documents
from .langid import identify_languages
from .licenses import scan_licenses
from .lm import score_documents
from .neardup import near_duplicates
from .packing import pack_documents
from .pii import extract_pii
from .suffix import remove_repeats
from .tokencount import count_tokens


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; POINTLOOM_TOKENIZERS names another folder than the installed one."""
    if folder := os.environ.get("POINTLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pii(_documents(spark, sf_dir).select("doc_id", "text"))


def op2_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op5_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"), similarity=85)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM split),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.c AS component_id, s.doc_id = l.c AS kept FROM sets s JOIN low l ON s.doc_id = l.x
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_contextual_pii, op2_latent_decontamination, op3_license_scan, op4_unigram_token_counts, op5_hierarchical_langid, op6_weighted_fingerprints, op7_recurrent_lm, op8_suffix_dedup, op9_bestfit_packing, op10_minhash_neardup)}


def oracle_sql() -> dict[str, str]:
    return {"op10_minhash_neardup": OP10_SQL}
