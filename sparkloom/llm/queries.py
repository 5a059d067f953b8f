"""The contract queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text_crc, table
from .hamming import SEARCH_SQL


def op5_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import layout, shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), layout(24), layout(25))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import search_embeddings

    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_documents

    return score_documents(table(spark, sf_dir, "documents"), F.pmod(id_text_crc("doc_id"), F.lit(7)) == 2)


def op7_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .metric_join import link_embeddings

    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict

    documents = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(id_text_crc("doc_id"), F.lit(3)) == 1, F.lit(False))
    model = fit(documents.where(~held).select("doc_id", "text", "lang"))
    return predict(documents, model, {"held_out": held})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, predict

    documents = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(id_text_crc("doc_id"), F.lit(4)) == 2, F.lit(False))
    return predict(documents, fit(documents.where(~held), table(spark, sf_dir, "labels")), extra={"held_out": held})


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import length_histogram, limits

    return limits(length_histogram(table(spark, sf_dir, "documents"), byte_bpe()), CONTEXT_LIMITS)


#: Context limits of which the answer is wanted whether a document has that length or not.
CONTEXT_LIMITS = tuple(1 << k for k in range(7, 21))


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), byte_bpe())


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(table(spark, sf_dir, "documents")).taken()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_length_histogram": op4_length_histogram,
    "op5_weighted_hash_tree": op5_weighted_hash_tree,
    "op6_katz_backoff": op6_katz_backoff,
    "op7_metric_range_join": op7_metric_range_join,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_linear_grouping": op9_linear_grouping,
    "op10_source_mixing": op10_source_mixing,
}
ORACLES: dict[str, str] = {"op1_multi_index_hashing": SEARCH_SQL}
