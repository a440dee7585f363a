"""The corpus pipeline: documents through five operators, each stage written and read again.

Quality rules drop documents; line dedup takes repeated lines out of texts; near-dedup leaves one
document of each group; decontamination drops documents that hold benchmark items; the last stage
adds the token ids of the byte-level BPE.

Documents without a text, or with an empty one, have no words and go with the first stage. Rows
are told apart by id and text: rows that share an id, or have none, are documents of their own, and of
repeated rows one stays. Ties are broken by the smallest id, rows without one last, and then by hashes
of the text and of the row, never by the order of partitions. Other columns are carried along as they
are (n_chars is made to fit the text), whatever their names; a column token_ids is replaced by the
last stage. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairgauge.llm import bpe, common, decontam, linededup, minhash, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.add_token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir))
    return docs


#: The last stage's token ids are beyond SQL; tests/llm/test_pipeline.py has a plain Python version of all stages.
ORACLE_SQL = None
