"""Corpus preparation: five filters in a row over ``documents``, each written and read again.

toxicity       rejects documents that the grammar predicts to be toxic
near_dedup     keeps one document (the smallest doc_id) of each near-duplicate component
suffix_dedup   cuts byte strings of 50 bytes and more that an earlier document holds too
decontaminate  drops documents that hold a benchmark passage
pack           packs what is left into sequences of 1024 tokens; a row a piece

All stages but the last return the columns of ``documents``.  A cut may fall inside a
character; the bytes of such a broken character go too.  A document whose text is cut
away entirely stays as a row with an empty text, as filters keep what they don't reject.

Null and empty texts are no one's copy and hold nothing toxic or leaked: they stay, and pack as the end id alone.  Rows
without doc_id pass the filters on their own text, are no one's copy or source, and aren't packed.  Of repeated rows of one
doc_id near_dedup keeps all or none; of equal texts the smallest doc_id stays.  Columns of any other name come through the
filters as they are.  An empty table gives an empty result, missing labels reject nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm import decontam, minhash, packing, suffixes, toxicity
from tesselon.llm.common import shared_dir
from tesselon.llm.queries import BYTE_VOCABULARY, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, shingle=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(docs, span=50)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary(BYTE_VOCABULARY), spaces=True, end_id=0, size=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]

#: The grammar's fitted model and the tokenizer can't be put into SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
