"""A training corpus in five stages, each a Spark job over all that the one before kept.

quality rules -> one document of each near-duplicate group -> no benchmark passages -> sources mixed to weights -> token files.

Every stage takes a table with the columns of documents (doc_id, text, lang, source, n_chars) and all but the last return
just these; further columns, whatever their names, are dropped. A table without rows passes through all stages. Nulls may be
in any column; repeated rows and texts of any length are allowed. What each stage does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave.llm.common import saved, table
from callweave.llm.decontamination import drop_contaminated
from callweave.llm.mixing import mix
from callweave.llm.near_duplicates import keep_one
from callweave.llm.quality_rules import filter_outliers
from callweave.llm.wavelet import written_and_read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source.

    Null, empty and blank texts fail the base rules. Null languages and sources are groups of their own. Repeated rows are
    judged alike. Null ids and n_chars don't matter.
    """
    return filter_outliers(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least id, null ids last; of repeated rows one. Texts without words (null, empty,
    blank) are no one's copies and stay. Languages and sources don't matter."""
    return keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null, empty and blank texts and items hold none; repeated rows go or stay together,
    with or without an id."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says. A null text has no words and a null source is a source of its own, the
    last. Repeated rows of one id are taken equally often, and all null ids are one id."""
    return mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the token files: in ascending order of ids, null ids first,
    equal ids by a hash of the text. A null or empty text has the end id only. Repeated rows are encoded each."""
    return written_and_read(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mixing), ("token files", tokens)]

#: The fit of the quality rules, MinHash and tokenisation can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = saved(out, "cw-stage") if k < len(STAGES) - 1 else out
    return docs
