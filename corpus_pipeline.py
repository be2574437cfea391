"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. run() writes each stage's rows as
Parquet in the shared folder and rereads them as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, packing, quality, simhash, suffix
from millrace.llm.common import documents, stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay; those with no letter, or no text, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or score under the fitted cut-off go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id stays of each group linked at 3 or fewer differing bits."""
    return simhash.keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 240 bytes are cut out of the texts; the first copy stays.

    A passage of over 50 words is longer than that in any language of the corpus. Nulls, empty and shorter
    texts stay as they are; rows that repeat a doc_id and text are one document.
    """
    return suffix.without_later_copies(docs, **suffix.PASSAGE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset, at most 4096 tokens a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL engine has the fitted models, XXH64 with a seed, or the tokenizer: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
