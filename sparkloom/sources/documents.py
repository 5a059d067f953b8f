"""Readers and writers of documents, pages, requests and reports. Every path is opened by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blocks

#: A request to rewrite pasted text.
REQUEST = T.StructType([T.StructField("text", T.StringType()), T.StructField("mode", T.StringType())])
#: Characters of pasted text that are accepted.
MOST_PASTED = 100_000
#: Bytes of a request.
MOST_BYTES = 1_000_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_blocks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, text: blocks of plain text between blank lines."""
    return documents.select(key, F.posexplode(blocks(F.col(text))).alias("pos", "text"))


def parse_requests(bodies: DataFrame, body: str = "body", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds request (null where invalid) and error (status, message) of JSON bodies, text or bytes; bytes have to be UTF-8 and no more than most_bytes."""
    valid = F.is_valid_utf8(F.col(body).cast("string"))
    parsed = F.from_json(F.when(valid, F.col(body).cast("string")), REQUEST, {"mode": "PERMISSIVE"})
    text = parsed["text"]
    status = F.when(F.octet_length(body) > most_bytes, 413).when(text.isNull(), 400).when(F.trim(text) == "", 400).when(F.length(text) > MOST_PASTED, 413)
    message = F.when(status == 413, F.lit("text too long")).otherwise(F.lit("text required"))
    return bodies.withColumn("request", F.when(status.isNull(), parsed)).withColumn("error", F.when(status.isNotNull(), F.struct(status.alias("status"), message.alias("message"))))


def to_json_rows(rows: DataFrame, name: str = "body") -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def write_parquet(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).parquet(path)


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def articles(blocks_: DataFrame, key: str) -> DataFrame:
    """Rewritten blocks (key, pos, original, text) as one article each: blocks in order and how many changed."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "original", "text")))
    return blocks_.groupBy(key).agg(ordered.alias("blocks"), F.count_if(F.col("text") != F.col("original")).alias("changed"))


def resources(pages: DataFrame) -> DataFrame:
    """url, kind, pages of everything that pages link to."""
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)), lambda u: F.struct(u.alias("url"), F.lit("link").alias("kind")))
    images = F.transform(F.regexp_extract_all("html", F.lit('src="([^"]+)"'), F.lit(1)), lambda u: F.struct(u.alias("url"), F.lit("image").alias("kind")))
    each = pages.select("page_id", F.explode(F.concat(links, images)).alias("r")).select("page_id", "r.*").distinct()
    return each.groupBy("url").agg(F.min("kind").alias("kind"), F.array_sort(F.collect_set("page_id")).alias("pages"))


def audit(report: DataFrame, body: str, headline: str, least_body: int = 8, least_headline: int = 1) -> DataFrame:
    """Adds ok: enough changes in body and headline."""
    return report.withColumn("ok", (F.col(body) >= least_body) & (F.col(headline) >= least_headline))
