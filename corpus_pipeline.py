"""Documents to training sequences: quality rules, language, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexweave.llm import langid, minhash, packing, rules
from hexweave.llm.tables import cut_texts, own_name, table
from hexweave.storage import cut

#: A language less likely than this rejects a document.
LEAST_LANGUAGE_SCORE = 0.5
#: Near-duplicates share 80 % of their five-word shingles or more; op7's own contract is minhash.PERCENT.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, with all their columns, whatever these are called.

    Null and empty texts and texts of fewer than 20 words go; rows are judged one by one, so repeated rows and ids and
    null ids are judged like others. An empty table gives an empty one.
    """
    model = rules.fit(docs, table(spark, sf_dir, "labels"))
    own = own_name(docs.columns, "judged")
    return docs.withColumn(own, rules.verdict(spark, model)).filter(F.col(own)["kept"]).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language is told with some confidence, with all their columns, whatever these are called.

    Texts without a letter go, and so do all where no row's `lang` teaches a language. Rows are judged one by one, so
    repeated rows and ids and null ids are judged like others. An empty table gives an empty one.
    """
    own = own_name(docs.columns, "told")
    told = docs.withColumn(own, langid.verdict(spark, langid.fit(docs)))
    return told.filter((F.col(own)["lang_pred"] != langid.UND) & (F.col(own)["lang_score"] >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: a row with the least doc_id, so exact repeats of a row stay once.

    Each row is a document of its own here, also where rows repeat a doc_id: other texts under one id are no group. A
    null doc_id and a text without words link with nothing, so their rows all stay.
    """
    own = own_name(docs.columns, "row")
    known = cut(docs.filter(F.col("doc_id").isNotNull()).withColumn(own, F.monotonically_increasing_id()))
    part = minhash.near_duplicates(known.select(F.col(own).alias("doc_id"), "text"), NEAR_PERCENT).select(F.col("doc_id").alias(own), "component_id")
    least = known.select(own, "doc_id").join(part, own).groupBy("component_id").agg(F.min(F.struct("doc_id", own)).alias("first"))
    kept = cut(least.select(F.col(f"first.{own}").alias(own)))
    return known.join(kept.hint("merge"), own, "left_semi").select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces and their places in sequences: see packing.pack.

    A null or empty text is one piece, its end id alone. Rows are packed one by one, so repeated rows and ids and null
    ids are packed like others; columns other than doc_id and text are not looked at.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: A learned model, MinHash and tokenizers have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_texts(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
