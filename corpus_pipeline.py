"""Corpus pipeline: the stages in order; each works on all documents that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of documents, the last one a row of token
figures for each document. docs is what the stage before returned, written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import decontamination, piece_bpe, simhash, suffix_dedup, toxicity
from fathom.llm.common import shared_folder
from fathom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.7 go. Trained on the labelled rows of docs outside the held-out fold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words to a shingle, similarity 0.8 or more) the smallest id stays.

    Rows with the id that stays remain together; rows without an id stay.
    """
    groups = simhash.similar_documents(docs, size=5, similarity=0.8)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has, too, are cut out; a document that has nothing
    else goes. n_chars is counted anew where a text changed."""
    return suffix_dedup.cut_passages(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages contaminate go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left."""
    return piece_bpe.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: SQL can express neither the string-kernel machine nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"  # each run has its own, so a later run leaves this result alone
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
