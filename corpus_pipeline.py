"""A corpus pipeline: toxicity, near duplicates, decontamination, mixing, token files.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame;
what one keeps is written as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditframe.llm import decontamination, minhash, mixing, token_files, toxicity
from auditframe.llm.scratch import Scratch

TOKENIZER = "byte_bpe_50k.json"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a grade above the first is likelier than not of go.

    A null or empty text stays, and so does everything without usable labels; rows that repeat a doc_id are judged each.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.grades_from(labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of shingle similarity 0.8 or more stays, the one with the smallest doc_id.

    Null, empty and blank texts and null doc_ids stay; rows that repeat a doc_id that stays, stay.
    """
    return minhash.without_near_duplicates(docs, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with tiles over 0.8 or more of a benchmark item go.

    Null and empty texts stay; null or short items are no evidence, and without items all stays.
    """
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by code point weigh 1, 2, 3, repeating, and share as many words as there are; at most 3 epochs.

    A null source is one, last; texts without words are taken as often as the cut of their source says.
    """
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files, and from them a row per document with its place and checksum.

    A null or empty text is the end id alone; null doc_ids come first; no documents give no file and no row.
    """
    return token_files.read_digests(spark, token_files.write(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", toxic),
    ("minhash", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixing", mix),
    ("token_files", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "corpus-pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A learnt classifier and a tokenizer are no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None
