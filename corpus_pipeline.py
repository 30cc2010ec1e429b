"""The text pipeline: documents through five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a table. All but the last
return the columns of documents, the last the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mixscore.llm.common import shared_folder
from mixscore.llm.decontamination import drop_contaminated
from mixscore.llm.line_dedup import dedup_lines
from mixscore.llm.near_dedup import drop_near_duplicates
from mixscore.llm.packing import pack_documents
from mixscore.llm.quality import drop_low_quality
from mixscore.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; ``n_chars`` follows the text."""
    return dedup_lines(docs, n_chars_col="n_chars").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens.

    Workers keep their memory from stage to stage, so they remember little here.
    """
    return pack_documents(docs, byte_bpe(), remembered_chunks=100_000)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# The language model and the tokens can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the table documents.

    A stage's folder is deleted once the next one is written; the last stays, as
    the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
