"""Interval and order operators on offsets: all DataFrame operations with an equality on the text's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def outside(edits: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Edits [start, end) that overlap no range [start, end) of their key; an empty edit counts where it stands inside one."""
    e, r = edits.alias("e"), ranges.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")).alias("r")
    meets = (F.col(f"e.{key}") == F.col(f"r.{key}")) & (F.col("e.start") < F.col("r._e")) & (F.greatest("e.end", F.col("e.start") + 1) > F.col("r._s"))
    return e.join(r, meets, "left_anti")


def merged(ranges: DataFrame, key: str, gap: int = 0) -> DataFrame:
    """Ranges of a key that overlap or lie no more than gap apart as one: key, start, end, parts."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts")).drop("_island")


def offsets(segments: DataFrame, key: str, pos: str, length: str) -> DataFrame:
    """Adds start and end of each segment by the running sum of lengths."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0).cast("long"))
    return segments.withColumn("start", start).withColumn("end", F.col("start") + F.col(length))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Adds to each left row the value of the last right row of its key at or before it.

    Both sides go through one shuffle and one window, not a range join: right rows carry their value
    forward.
    """
    columns = left.columns
    marked = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    other = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns], F.col(value).alias("_v"), F.lit(0).alias("_left"))
    order = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return marked.unionByName(other).withColumn(out, F.last("_v", ignorenulls=True).over(order)).where("_left = 1").drop("_v", "_left")


def budget_split(rows: DataFrame, key: str, pos: str, length: str, most: int) -> DataFrame:
    """Adds in_head: whether the running length up to and with this row stays within most. Lengths are not negative, so heads are prefixes."""
    upto = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_head", F.sum(length).over(upto) <= most)


def first_n(rows: DataFrame, key: str, pos: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where(F.col("_n") <= n).drop("_n")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the largest by; an aggregation, which combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(by, *[c for c in rest if c != by])).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def best_source(rows: DataFrame, key: str, size: str, pos: str, wanted: int) -> DataFrame:
    """Of each key the candidate nearest to the wanted size from below, else the smallest above; the first of equals."""
    score = F.when(F.col(size) <= wanted, F.col(size) / F.lit(float(wanted))).otherwise(-F.col(size) / F.lit(float(wanted)))
    best = rows.withColumn("score", score).groupBy(key).agg(F.max(F.struct("score", (-F.col(pos)).alias("_p"), F.col(size))).alias("_b"))
    return best.select(key, (-F.col("_b._p")).alias(pos), F.col(f"_b.{size}").alias(size), F.col("_b.score").alias("score"))


def subtree_share(nodes: DataFrame, most: float = 0.5) -> DataFrame:
    """Of (root, ancestor, node, size) pairs: each ancestor's summed size, its share of its root and whether it may go (share at most `most`)."""
    sums = nodes.groupBy("root", "ancestor").agg(F.sum("size").alias("size"))
    total = nodes.select("root", "node", "size").distinct().groupBy("root").agg(F.sum("size").alias("total"))
    return sums.join(total, "root").withColumn("share", F.col("size") / F.col("total")).withColumn("removable", F.col("share") <= most)
