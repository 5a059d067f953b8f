"""What the operators share: cutting lineage, distributed running sums, joins with small tables, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of at most so many narrow rows may be broadcast.
SMALL_ROWS = 100_000
#: Edges of up to so many nodes, 32 MB, are joined in one task.
ONE_TASK = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; a folder of its own only where none is set and executors are threads of this process, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loom-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_text_crc(column: str) -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], value: str, start: str = "start", row: str | None = None) -> DataFrame:
    """Adds the exclusive running sum of value within group, by bucket and then order.

    Totals of the buckets come from a pre-aggregation, so the longest sort is that of one bucket and
    not of one group: a group with a third of all rows is spread over all its buckets. Group and
    bucket columns hold no nulls. row names a column for the row's number within its bucket.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(base, [*group, bucket])
    out = out.withColumn(start, (F.col("_base") + F.coalesce(F.sum(value).over(earlier), F.lit(0))).cast("long"))
    if row:
        out = out.withColumn(row, F.row_number().over(within))
    return out.drop("_base")


def placed(df: DataFrame, group: list[str], identity: list[str], value: Column, start: str, per_bucket: int = 50_000, run: int = 1 << 16) -> DataFrame:
    """Each row's group and identity columns, and in start the exclusive running sum of value, an expression of the identity, within the group.

    Rows are ordered by a hash of their identity and then the identity, so the order is the same in
    every run. Rows with one identity are counted before anything is sorted and written out again
    afterwards, in several tasks where they are many; they take neighbouring places. A group is cut into
    buckets by its number of different rows, so neither a hot group nor a hot row is one task's work.
    Identities may hold nulls, groups may not.
    """
    kinds = cut(df.groupBy(*group, *identity).agg(F.count("*").alias("_rows")).withColumn("_value", value.cast("long")))
    sizes = cut(kinds.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(per_bucket))).cast("int").alias("_buckets"), F.max("_rows").alias("_most")))
    small = sizes.count() <= SMALL_ROWS
    kinds = kinds.join(F.broadcast(sizes) if small else sizes, group)
    kinds = kinds.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("place"), *identity), F.col("_buckets")).cast("int")).withColumn("_sum", F.col("_value") * F.col("_rows"))
    order = [F.xxhash64(F.lit("order"), *identity), *identity]
    found = running_sum(kinds.drop("_buckets", "_most"), group, "_bucket", order, "_sum", start)

    def copies(rows: DataFrame, numbers: str) -> DataFrame:
        return rows.withColumn("_copy", F.explode(F.expr(numbers))).select(*group, *identity, (F.col(start) + F.col("_copy") * F.col("_value")).alias(start))

    if (sizes.agg(F.max("_most")).first()[0] or 0) <= run:
        return copies(found, "sequence(0L, _rows - 1)")
    found = cut(found)
    many = found.where(F.col("_rows") > run).withColumn("_run", F.explode(F.expr(f"sequence(0L, (_rows - 1) div {run})")))
    many = many.repartition(F.col("_run"), *identity)
    return copies(found.where(F.col("_rows") <= run), "sequence(0L, _rows - 1)").unionByName(copies(many, f"sequence(_run * {run}, least(_rows, (_run + 1) * {run}) - 1)"))


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Joins a table that is meant to be small (and is cut already) on one key that may be hot.

    Its rows are counted: up to SMALL_ROWS it is broadcast, beyond that both sides are salted.
    """
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return big.join(F.broadcast(small), key, how)
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(many, [key, "_salt"], how).drop("_salt")


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node that each reaches: roots hook to smaller neighbours and paths are halved until nothing moves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        x, y = parent[x], parent[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[parent]


def _contracted(batches):
    """For mapInArrow: edges (a, b) as the forest (node, smallest reached) that holds a partition's nodes together."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > ONE_TASK:
            held = [settled(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
    if held:
        node, root = settled(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK, forest: bool = False) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, component), component being the smallest node.

    Every partition first contracts its own edges to a forest, unless they are (nearly) one. Where the forests' edges are one_task at
    most, one task joins them; they are counted first, so what it holds is bounded. Beyond that
    large-star and small-star contraction alternate: each half round is an aggregation and a join that
    Spark may split where a node is hot, and edges never meet in one place. Both ways give the same
    rows. Self-loops and repeated edges are allowed, nulls are not. No edges give no rows.
    """
    edges = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = cut(edges if forest else edges.mapInArrow(lean(_contracted), "a long, b long"))
    if now.count() <= one_task:
        return now.repartition(1).mapInArrow(lean(_contracted), "node long, component long")
    now = cut(now.distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a <> b").union(now.where("a = b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        now = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b"))
    return ends.groupBy("node").agg(F.min("component").alias("component"))


def chunks(texts: Iterable[str], most: int = 300_000):
    """Runs of texts with about so many characters each, as (first index, texts); bounds the memory of vectorised code."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= most:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def lean(run):
    """A function for mapInArrow that gives its worker's free memory back when it ends; workers are used again by other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)
