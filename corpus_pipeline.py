"""The corpus pipeline: toxicity, quality rules, SimHash near-duplicates, best-fit packing.

Each stage takes all rows that the one before kept; the first three return the columns of
documents. run() writes each stage's rows as Parquet in the cluster's shared folder and reads them
again, so that a later stage never repeats an earlier one; a folder that the next stage has read
is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fascicle.llm import bestfit_pack, quality_cascade, simhash_similar, toxicity_nbsvm
from fascicle.llm.common import read, shared_folder
from fascicle.llm.queries import tokenizer_file

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labels that docs has."""
    model = toxicity_nbsvm.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity_nbsvm.score(F.col("text"), model) < 0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return quality_cascade.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (shingle sets that agree by 0.8 or more)."""
    return simhash_similar.keep_first(docs, size=SHINGLE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed piece of a document, with its token ids (little-endian unsigned 32-bit)."""
    return bestfit_pack.pack(docs, tokenizer_file("word_bpe_49k.json").decode(), tokens=True)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Hashing, learning and tokenising are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; only its folder stays."""
    docs, own = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{own}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        before = path
    return docs
