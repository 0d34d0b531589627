"""A training corpus from raw documents, stage by stage.

Each stage reads what the one before has written. All but the last return rows of documents as they are; the last returns their tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from prismflow.llm import bpe, common, decontaminate, exact, langid, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled documents of the stage's own input."""
    return langid.drop_rejected(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, common.documents(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_le (token ids as little-endian 32-bit integers) and the text decoded from them of each document that is left."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: Learned languages and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's output written as Parquet to the shared checkpoint folder and read again; what no later stage reads is deleted."""
    where = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}_{name}")
            docs = spark.read.parquet(f"{where}/{k}_{name}")
            if k:
                drop(spark, f"{where}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
