"""Hierarchical weighted hash tree: region, rack and shard levels by weighted hash draws.

At every level a document draws one number per child from a hash of its id and the child's path, and
goes to the child with the smallest -ln(u) / weight (an exponential race, so that children win in
proportion to their weights). A child's draw does not depend on its siblings: when the weight of one
subtree grows, documents move into that subtree only; when it shrinks, out of it only. A shard beyond
the planned ones opens a region of its own, so it takes documents only into itself.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed

UNIT = float(1 << 53)


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def layout(shards: int, planned: int = 24, per_rack: int = 4, per_region: int = 8) -> list[Leaf]:
    """Planned shards fill racks and regions in order; each further shard has a region of its own."""
    own = -(-planned // per_region)
    return [Leaf(s // per_region, s % per_region // per_rack, s) if s < planned else Leaf(own + s - planned, 0, s) for s in range(shards)]


def _draw(key: Column, seed: int, path: tuple[int, ...], weight: float) -> Column:
    h = F.xxhash64(F.lit(f"{seed}/{'/'.join(map(str, path))}"), key)
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / UNIT
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(path[-1]).alias("child"))


def _win(key: Column, seed: int, children: dict[tuple[int, ...], float]) -> Column:
    draws = [_draw(key, seed, path, w) for path, w in sorted(children.items()) if w > 0]
    return F.array_min(F.array(*draws))["child"] if len(draws) > 1 else draws[0]["child"]


def _choose(node: Column, cases: dict[int, Column]) -> Column:
    out = None
    for k, c in sorted(cases.items()):
        out = F.when(node == k, c) if out is None else out.when(node == k, c)
    return out


def descend(df: DataFrame, key: str, tree: list[Leaf], out: str, seed: int = 5) -> DataFrame:
    """Adds column out, the shard that key falls to. Weights may be any non-negative numbers, not all zero."""
    regions: dict = defaultdict(float)
    racks: dict = defaultdict(lambda: defaultdict(float))
    leaves: dict = defaultdict(dict)
    for leaf in tree:
        regions[leaf.region,] += leaf.weight
        racks[leaf.region][leaf.region, leaf.rack] += leaf.weight
        leaves[leaf.region, leaf.rack][leaf.region, leaf.rack, leaf.shard] = leaf.weight
    live = [r for (r,), w in regions.items() if w > 0]
    col = F.col(key)
    df = df.withColumn("_region", _win(col, seed, regions))
    df = df.withColumn("_rack", _choose(F.col("_region"), {r: _win(col, seed, racks[r]) for r in live}))
    shard = {r: _choose(F.col("_rack"), {k[1]: _win(col, seed, v) for k, v in leaves.items() if k[0] == r and sum(v.values()) > 0}) for r in live}
    return df.withColumn(out, _choose(F.col("_region"), shard)).drop("_region", "_rack")


def shard_documents(documents: DataFrame, tree: list[Leaf], grown: list[Leaf], seed: int = 5) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes, size 8 and checksum 0. Rows with
    equal ids go to one shard; a null id is a key like any other. Slots count a shard's rows from 0
    without gaps, by a hash of id, checksum and size; wholly equal rows take neighbouring slots.
    Other columns of the input are not looked at. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = descend(descend(rows, "doc_id", tree, "shard", seed), "doc_id", grown, "grown_shard", seed)
    rows = placed(rows, ["shard"], ["doc_id", "text_crc32", "size", "grown_shard"], F.lit(1), "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
