"""The corpus pipeline: quality rules, line, near-duplicate and substring removal, packing.

Each stage works on all that the one before kept, is written as Parquet and read again. All but the last
return the columns of ``documents``; a stage that changes texts also sets n_chars to their code points.
Texts that lose everything stay as empty documents. The last returns the pieces of ``packing.pack``.

Defined results: null texts are empty, and the quality rules drop them; repeated rows of one doc_id and text are one document
after the near-duplicate stage; columns that no stage knows stay as they are up to packing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import line_dedup, near_dup, packing, quality_rules, suffix_dedup
from lumenfield.llm.common import unused, written


def _stage(work: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that calls ``work`` with columns that no stage knows out of the way of those that its operator adds."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"_other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source", "n_chars")}
        return work(docs.withColumnsRenamed(own)).withColumnsRenamed({v: k for k, v in own.items()})

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


def _with_text(out: DataFrame, text: str, columns: list[str]) -> DataFrame:
    return out.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(columns)


@_stage
def quality(docs: DataFrame) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality_rules.judge(docs).where("kept").select(docs.columns)


@_stage
def lines(docs: DataFrame) -> DataFrame:
    """Lines that an earlier document holds go."""
    return _with_text(line_dedup.dedup_lines(docs), "kept_text", docs.columns)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each class of near duplicates, the document with the least doc_id stays, and of its repeated rows one."""
    key, = unused(docs, "_text")
    out = near_dup.classes(docs).where("kept").select(docs.columns).withColumn(key, F.md5(F.coalesce("text", F.lit(""))))
    return out.dropDuplicates(["doc_id", key]).drop(key)


@_stage
def substrings(docs: DataFrame) -> DataFrame:
    """Byte strings of 400 and passages of over 50 words that repeat go, with the characters that a cut goes through."""
    return _with_text(suffix_dedup.remove_repeats(docs, passage_words=suffix_dedup.PASSAGE_WORDS, as_text=True), "kept", docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", substrings), ("best_fit_packing", packed)]

#: SQL has neither the tokeniser nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
