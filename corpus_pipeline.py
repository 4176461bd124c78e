"""Corpus pipeline: language ID, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the last
returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrabag.llm.common import materialize
from terrabag.llm.language_id import keep_known_languages
from terrabag.llm.line_dedup import line_dedup
from terrabag.llm.mixing import mix_sources
from terrabag.llm.near_dedup import keep_one_of_each
from terrabag.llm.packing import pack
from terrabag.llm.queries import documents, tokenizer_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without letters go.

    Repeated rows and rows of null ids are judged each for itself; an empty table stays empty; columns stay as they are.
    """
    return keep_known_languages(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur elsewhere; n_chars follows the text.

    All rows stay. A text that would lose every line stays whole: the next stage drops copies, but would keep empty texts. Null texts stay
    null; rows that repeat an id and its text count once; an empty table stays empty.
    """
    return line_dedup(docs, keep_whole=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, a null id being least.

    Null and empty texts are near nothing and stay; rows that repeat an id and its text stay together; an empty table stays empty.
    """
    return keep_one_of_each(docs, percent=80, width=5)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target weights, shuffled.

    A null source is one of its own; sizes come from n_chars, null or 0 counting as 1; rows that repeat an id are repeated alike; an
    empty table stays empty.
    """
    return mix_sources(docs, seed=42).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, one row a piece.

    A null or empty text is its end token alone; repeated rows are documents of their own; an empty table gives no pieces.
    """
    return pack(docs, tokenizer_file())


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mix_sources", mix_stage), ("pack", pack_stage)]

#: MinHash and language vectors have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
