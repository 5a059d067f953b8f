"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing to target weights, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import langid, toxicity
from sparkloom.llm.common import checkpoint_dir, table
from sparkloom.llm.jaccard_join import representatives
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.packing import pack
from sparkloom.llm.queries import byte_bpe


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models of the documents' own languages accept."""
    return langid.accepted(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def ordinary_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by the models of the labelled ones."""
    return toxicity.ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as a mix of their sources takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents packed into sequences."""
    return pack(docs, byte_bpe())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("toxicity", ordinary_documents),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written to the shared checkpoint folder and read again.

    What a stage wrote is removed when the next one has written; the last stage's input stays, as its
    result is computed when it is asked for.
    """
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        written = f"{folder}/{k}_{name}"
        out.write.parquet(written)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(written), written
    return docs


#: Models, components and permutations are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
