import math
import zlib
from collections import Counter, defaultdict

import xxhash

from sparkloom.llm.sharding import Leaf, descend, layout, shard_documents
from tests.llm import edges


def test_edges(spark):
    found = shard_documents(edges.documents(spark), layout(24), layout(25)).collect()
    assert edges.got_ids(found) == edges.ids()
    by_id = {r["doc_id"]: r for r in found}
    assert (by_id[1]["size"], by_id[1]["text_crc32"]) == (8, 0) and by_id[4]["size"] == 11
    assert all(r["law"] == "key" for r in found)
    assert shard_documents(edges.documents(spark, []), layout(24), layout(25)).count() == 0


def spark_hash(*values):
    """What xxhash64 of a string and a long, or a null, gives: each value is hashed with the hash so far as seed."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed


def brute(key, tree, seed=5):
    """The leaf that key falls to, by weighted draws level by level."""
    path = ()
    for level in range(3):
        children = defaultdict(float)
        for leaf in tree:
            if leaf[:level] == path:
                children[leaf[: level + 1]] += leaf.weight
        draw = {c: -math.log(((spark_hash(f"{seed}/{'/'.join(map(str, c))}", key) >> 11) + 0.5) / 2**53) / w for c, w in children.items() if w > 0}
        path = min(draw, key=lambda c: (draw[c], c[-1]))
    return path[2]


def test_equals_brute_force(spark):
    found = shard_documents(edges.documents(spark, edges.ROWS + [(k, "more") for k in range(100, 400)]), layout(24), layout(25)).collect()
    text = {i: t or "" for i, t in edges.ROWS}
    for r in found:
        data = text.get(r["doc_id"], "more").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert (r["shard"], r["grown_shard"]) == (brute(r["doc_id"], layout(24)), brute(r["doc_id"], layout(25)))


def test_slots_are_gapless_and_growth_takes_into_itself(spark):
    rows = [(i, f"text {i}") for i in range(6000)] + [(7, "again")] * 3
    found = shard_documents(edges.documents(spark, rows), layout(24), layout(25)).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert len(slots) == 24 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 120 < sum(r["grown_shard"] == 24 for r in found) < 380
    assert all(170 < len(s) < 340 for s in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) == 1


def test_movement_stays_in_changed_subtrees(spark):
    df = spark.range(20_000)
    tree = [Leaf(r, k, 4 * r + 2 * k + s) for r in range(2) for k in range(2) for s in range(2)]
    less = [leaf._replace(weight=0.5) if leaf.shard == 0 else leaf for leaf in tree]
    a, b = descend(df, "id", tree, "a"), descend(df, "id", less, "b")
    moved = Counter((r["a"], r["b"]) for r in a.join(b, "id").where("a <> b").collect())
    # The shrunken shard's own rack, and its region, lose documents; nothing moves between others.
    assert all(x in (0, 1, 2, 3) for x, _ in moved) and sum(moved.values()) < 4500
    assert all(x == 0 or y not in (0,) for x, y in moved)


def test_weights_are_met(spark):
    tree = [Leaf(0, 0, 0, 1.0), Leaf(0, 1, 1, 2.0), Leaf(1, 0, 2, 5.0), Leaf(1, 0, 3, 0.0)]
    n = Counter(r["s"] for r in descend(spark.range(16_000), "id", tree, "s").collect())
    assert abs(n[0] - 2000) < 250 and abs(n[1] - 4000) < 300 and abs(n[2] - 10_000) < 400 and 3 not in n
