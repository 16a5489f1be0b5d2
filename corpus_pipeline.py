"""The corpus pipeline: five stages, each the whole of what the one before kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of docs in
all stages but the last. ``run`` writes what a stage returns to the shared folder and reads it for the next.

Every stage passes rows with nulls on, but for those it rejects by its own rule: a null or letterless text has no language and
goes in the first stage. Empty tables run through to an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import decontaminate, language, packing, simhash, toxicity
from docsift.llm.shared import discard, save, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; learned from the labelled documents that aren't held out."""
    known = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return language.keep_known(docs, language.fit(known))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.remainder() != 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, single hits are cut out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids."""
    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", pack),
]

#: SQL can't express the fitted models and the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage was given is deleted once its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, sf_dir), name)
        discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
