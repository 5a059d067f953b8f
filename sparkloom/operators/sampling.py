"""Sampling without repeats, by a deterministic order of each cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cycles(items: DataFrame, key: str, n_cycles: int, seed: str, partition: str | None = None) -> DataFrame:
    """Adds cycle and place: every item once a cycle in an order of its own, and no cycle begins with the last item of the one before.

    Items are those of a list to pick from, one list for each value of partition.
    """
    by = [partition] if partition else []
    each = items.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(n_cycles - 1)))).withColumn("_h", F.md5(F.concat_ws("/", F.lit(seed), F.col("cycle").cast("string"), F.col(key).cast("string"))))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy(*by, "cycle").orderBy("_h")) - 1)
    size = F.count("*").over(Window.partitionBy(*by, "cycle"))
    last_of = each.withColumn("_last", F.col("place") == size - 1)
    ends = last_of.where("_last").select(*by, (F.col("cycle") + 1).alias("cycle"), F.col(key).alias("_end"))
    each = each.withColumn("_n", size).join(ends, [*by, "cycle"], "left")
    # A cycle that would begin with that item gives it the second place instead.
    clash = F.max(F.when((F.col("place") == 0) & (F.col(key) == F.col("_end")) & (F.col("_n") > 1), 1).otherwise(0)).over(Window.partitionBy(*by, "cycle"))
    moved = F.when((clash == 1) & (F.col("place") < 2), 1 - F.col("place")).otherwise(F.col("place"))
    return each.withColumn("place", moved.cast("int")).drop("_h", "_n", "_end")


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen.select(key).distinct(), key, "left_anti")


def allowed_only(saved: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return saved.join(items.select(key).distinct(), key, "left_semi")
