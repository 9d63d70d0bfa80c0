"""From raw documents to packed sequences: each stage works on what its predecessor kept.

1. language: documents that are in none of the languages learned go: null texts, texts without a letter, and texts whose
   profile has no more in common with any language than chance gives.
2. exact: of equal texts (runs of white space counted as one space) the one with the smallest doc_id stays.
3. near: of each SimHash component the document with the smallest doc_id stays.
4. decontaminate: documents of which at least 5 % of the words lie in benchmark windows go.
5. pack: the rest, tokenised, in sequences of 1024 tokens.

Stages 1-4 return the columns of documents; the last one a row for each piece (see tessera.llm.packing). Nulls,
empty tables, ties and repeated rows have the results that the operators' modules state. What a stage writes for itself,
and what its predecessor handed on, is deleted as soon as its own result is written. The other operators do not filter or
lay out documents of this corpus for training and so are no stages: they judge (toxicity, personal data, licences, urls of
pages) or rewrite texts (substrings), which is left to who uses the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, exact_dedup, lang_id, packing, simhash
from tessera.llm.common import forget, materialize, small_batches, table
from tessera.plans import shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)  # for all stages that follow
    return lang_id.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: No SQL can express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one written and read again."""
    docs, since = table(spark, sf_dir, "documents"), len(shared.WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        forget(spark, since, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
