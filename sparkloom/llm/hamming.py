"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into m segments, each indexed by its value. A query looks up its own
segments first, then all values one bit away, two bits away and so on. After radius r has been looked
up in all segments, a code that is not found yet differs by more than r in every segment, so it is at
distance m (r + 1) or more: a query is settled once its k-th verified distance is below that. Each
code is verified once only, at the first segment and radius that find it.

Equal codes are one class. Of a class only its k + 1 smallest ids can be among the k nearest of any
query (ties go to the smaller id, and a query may have to leave out itself), so only these are kept.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 64


def sign_codes(embeddings: DataFrame, bits: int = BITS) -> DataFrame:
    """vec_id and code: bit i is set where component i is above zero; missing, null and NaN components are not. Rows with a null id or vector are left out."""
    v = F.col("embedding")
    part = [F.when(F.coalesce((F.get(v, i) > 0) & ~F.isnan(F.get(v, i)), F.lit(False)), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    code = part[0]
    for p in part[1:]:
        code = code.bitwiseOR(p)
    return embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))


def _segment(code, j: int, width: int):
    return F.shiftrightunsigned(code, j * width).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, r: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), r)]


def segments_for(classes: int, bound: int) -> int:
    """How many segments to cut codes into: the fewest lookups and verifications to cover distance bound among so many codes."""

    def work(m: int) -> float:
        width = BITS // m
        probes = m * sum(comb(width, r) for r in range(min(width, bound // m) + 1))
        return probes * (1 + classes / 2**width)

    return min((2, 4, 8, 16), key=work)


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, distance: of each row of queries (vec_id, code) the k nearest other rows of codes, ties to the smaller id.

    Repeated rows of codes are separate neighbours, repeated queries are answered once. With fewer
    than k other rows all of them are returned. The k-th distance within a bounded sample of the
    codes bounds a query's distances from the start, so that lookups return few rows; it also says
    into how many segments codes are best cut (segments, if given, overrides it). Neither changes
    the result.
    """
    ids = Window.partitionBy("code").orderBy("vec_id")
    few = codes.select("vec_id", "code").withColumn("_nth", F.row_number().over(ids)).where(F.col("_nth") <= k + 1)
    classes = cut(few.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    some = np.array([r["code"] for r in classes.select("code").orderBy(F.xxhash64("code")).limit(sample).collect()], dtype=np.int64).view(np.uint64)

    def bounds(batches):
        for pdf in batches:
            q = pdf["q"].to_numpy().view(np.uint64)
            if len(some) > k:
                for start in range(0, len(q), 256):
                    far = np.bitwise_count(q[start : start + 256, None] ^ some[None, :])
                    pdf.loc[pdf.index[start : start + 256], "bound"] = np.partition(far, k, axis=1)[:, k].astype(np.int32)
            yield pdf

    asked = cut(queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")).distinct())
    open_ = cut(asked.select("q").distinct().withColumn("bound", F.lit(BITS)).mapInPandas(bounds, "q long, bound int"))
    if segments is None:
        middle = open_.agg(F.percentile("bound", 0.5)).first()[0]
        segments = segments_for(classes.count(), int(middle or BITS))
    width = BITS // segments
    index = cut(classes.select("code", "ids", F.posexplode(F.array(*[_segment(F.col("code"), j, width) for j in range(segments)])).alias("j", "value")))
    best = None
    for r in range(width + 1):
        each = open_.select("q", "bound", F.posexplode(F.array(*[_segment(F.col("q"), j, width) for j in range(segments)])).alias("j", "own"))
        probes = each.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(width, r)]))).select("q", "bound", "j", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        differs = F.col("p.q").bitwiseXOR(F.col("x.code"))
        distance = F.bit_count(differs)
        first = F.lit(True)
        for i in range(segments):
            d = F.bit_count(_segment(differs, i, width))
            first = first & F.when(F.lit(i) < F.col("p.j"), d > r).when(F.lit(i) > F.col("p.j"), d >= r).otherwise(True)
        met = probes.hint("merge").alias("p").join(index.alias("x"), (F.col("p.j") == F.col("x.j")) & (F.col("p.value") == F.col("x.value")) & (distance <= F.col("p.bound")) & first)
        found = met.select("p.q", "x.ids", distance.alias("distance"))
        best = found if best is None else best.unionByName(found)
        nth = Window.partitionBy("q").orderBy("distance", F.col("ids")[0])
        best = cut(best.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= k + 1).drop("_nth"))
        upto = Window.partitionBy("q").orderBy("distance")
        so_far = best.withColumn("_n", F.sum(F.size("ids")).over(upto)).where(F.col("_n") >= k + 1)
        kth = so_far.groupBy("q").agg(F.min("distance").alias("_kth"))
        open_ = open_.join(kth, "q", "left").select("q", F.least("bound", F.coalesce("_kth", F.lit(BITS))).alias("bound"))
        open_ = cut(open_.where(F.col("bound") >= segments * (r + 1)))
        if open_.isEmpty():
            break
    each = asked.join(best, "q").select("query_id", "distance", F.explode("ids").alias("vec_id"))
    # One occurrence of the query itself is left out, not its copies.
    own = Window.partitionBy("query_id", "distance", "vec_id").orderBy(F.lit(0))
    each = each.withColumn("_same", F.row_number().over(own)).where(~((F.col("vec_id") == F.col("query_id")) & (F.col("distance") == 0) & (F.col("_same") == 1)))
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def search_embeddings(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest sign codes of every row whose id is divisible by every, against all rows."""
    codes = cut(sign_codes(embeddings))
    return top_k(codes, codes.where(F.col("vec_id") % every == 0), k)


#: Brute force in SQL, for the check of results.
SEARCH_SQL = """
with codes as (
  select vec_id, list_sum([case when coalesce(embedding[i] > 0 and not isnan(embedding[i]), false) then (1::hugeint << (i - 1)) else 0 end for i in range(1, 65)])::hugeint as code
  from embeddings where vec_id is not null and embedding is not null),
pairs as (
  select q.vec_id as query_id, c.vec_id, bit_count(xor(q.code, c.code))::int as distance
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, distance from ranked where rank <= 10
"""
