"""The opN_ queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .language_id import language_id
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_dedup
from .packing import pack
from .secret_scan import secret_spans
from .suffix_dedup import repeated_bytes
from .token_count import token_counts
from .winnowing import fingerprints

#: The vocabulary of token counts and packing.
VOCABULARY = "word_bpe_49k.json"


def tokenizer_file(name: str = VOCABULARY) -> str:
    """Where a public tokenizer's file is installed; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), percent=85, width=5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file())


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), seed=42)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


OP8_SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, chr(0)) AS src, sum(greatest(coalesce(n_chars, 0), 1))::DOUBLE AS size FROM documents GROUP BY 1
), rates AS (
  SELECT src, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), split AS (
  SELECT src, greatest(ceil(rate / 64.0::DOUBLE)::BIGINT, 1) AS parts, rate / greatest(ceil(rate / 64.0::DOUBLE)::BIGINT, 1) AS mean FROM rates
), dist AS (
  SELECT src, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM split
  UNION ALL
  SELECT src, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM dist WHERE k < 160
), draws AS (
  SELECT d.*, s.src, j.part, ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j.part::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM documents d JOIN split s ON coalesce(d.source, chr(0)) = s.src, LATERAL (SELECT unnest(range(1, s.parts + 1)) AS part) j
), times AS (
  SELECT w.doc_id, w.text, w.lang, w.source, w.n_chars, sum((SELECT count(*) FROM dist WHERE dist.src = w.src AND dist.c <= w.u)) AS n
  FROM draws w GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1)) AS mix_copy FROM times WHERE n > 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_secret_spans": op3_secret_spans,
        "op4_repeated_bytes": op4_repeated_bytes,
        "op5_pack": op5_pack,
        "op6_language_id": op6_language_id,
        "op7_line_dedup": op7_line_dedup,
        "op8_mix_sources": op8_mix_sources,
        "op9_fingerprints": op9_fingerprints,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": OP8_SQL, "op10_exact_dedup": OP10_SQL}
