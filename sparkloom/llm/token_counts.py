"""Exact length histogram: documents counted by encoded length; suffix sums answer every context limit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, running_sum
from .encode import ids

#: Lengths of one bucket of the running sums.
SPAN = 256


def length_histogram(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (length, docs): how many documents have so many token ids. Null and empty texts have length 0.

    Every whole text is encoded. Tasks count their own documents first, so what is shuffled is a row
    per length and task, however often one length occurs. Columns beside text are not looked at.
    """

    def count(batches):
        import pyarrow as pa

        held: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0):
                n = len(ids(tokenizer, text.as_py()))
                held[n] = held.get(n, 0) + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(held.keys(), np.int64)), pa.array(np.fromiter(held.values(), np.int64))], ["length", "docs"])

    return documents.select("text").mapInArrow(lean(count), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def limits(histogram: DataFrame, also: Sequence[int] = ()) -> DataFrame:
    """One row per occurring length, and per length in also, taken as context limit: context_limit, docs_at, docs_over, docs_total, tokens_over, tokens_total, truncated_total, share_within.

    docs_over and tokens_over are suffix sums over longer documents; truncated_total is the tokens
    left when every document is cut at the limit; share_within is the share of documents that fit,
    so the q-quantile is the least limit with share_within >= q. An empty histogram gives no rows.
    """
    if also:
        none = histogram.sparkSession.createDataFrame([(int(n), 0) for n in also], "length long, docs long")
        histogram = histogram.unionByName(none).groupBy("length").agg(F.sum("docs").alias("docs"))
    h = cut(histogram).withColumn("tokens", F.col("length") * F.col("docs")).withColumn("_all", F.lit(0)).withColumn("_span", F.expr(f"length div {SPAN}"))
    h = running_sum(h, ["_all"], "_span", ["length"], "docs", "docs_before")
    h = running_sum(h, ["_all"], "_span", ["length"], "tokens", "tokens_before")
    docs, tokens = h.agg(F.sum("docs"), F.sum("tokens")).first()
    h = h.where(F.lit(bool(docs))).withColumn("docs_total", F.lit(docs).cast("long")).withColumn("tokens_total", F.lit(tokens).cast("long"))
    over = F.col("docs_total") - F.col("docs_before") - F.col("docs")
    h = h.withColumn("docs_over", over).withColumn("tokens_over", F.col("tokens_total") - F.col("tokens_before") - F.col("tokens"))
    return h.select(
        F.col("length").alias("context_limit"), F.col("docs").alias("docs_at"), "docs_over", "docs_total", "tokens_over", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_total"), ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("share_within"),
    )


def at_limits(histogram: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """The rows of limits() for the context limits that are wanted, whether any document has that length or not."""
    return limits(histogram, wanted).where(F.col("context_limit").isin([int(n) for n in wanted]))


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row (share, context_limit) per share: the least context limit of a table of limits() within which at least that share of documents fits; none for an empty table."""
    asked = F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")
    return table.select("context_limit", "share_within", asked).where(F.col("share_within") >= F.col("share")).groupBy("share").agg(F.min("context_limit").alias("context_limit"))
