from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm.common import placed
from sparkloom.llm.mixing import Mix, mixed_documents, shuffled_index
from tests.llm import edges


def targets(sizes, cycle=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_permutation_of_any_size(spark):
    for n in (1, 2, 3, 17, 100, 4097):
        df = spark.range(n).withColumn("n", F.lit(n).cast("long"))
        got = [r["p"] for r in shuffled_index(df, "id", "n", "p", [F.lit(3)]).orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        assert n < 50 or got != list(range(n))


def test_edges(spark):
    found = Mix(edges.documents(spark), block=8).taken().collect()
    assert edges.got_ids(found) == edges.ids()
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    assert {r["doc_id"]: r["size"] for r in found}[1] == 0
    assert Mix(edges.documents(spark, [])).taken().count() == 0
    assert mixed_documents(edges.documents(spark, [])).count() == 0
    assert mixed_documents(edges.documents(spark), block=8).columns == edges.documents(spark).columns


def corpus(spark):
    rows = [(i, f"s{i % 7}" if i % 11 else None, " ".join(f"w{i}_{k}" for k in range((i * 37) % 90 if i % 7 else 400))) for i in range(400)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_repeatability(spark):
    rows, df = corpus(spark)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    first, again = (sorted(map(repr, Mix(x, block=8).taken().collect())) for x in (df, df.repartition(7)))
    assert first == again
    source = {i: s for i, s, _ in rows}
    taken = defaultdict(int)
    for r in Mix(df, block=8).taken().collect():
        s = source[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, r["target"])
        taken[s] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 16


def permuted(at, size, key, rounds=14):
    """The swap-or-not shuffle of shuffled_index for one index."""
    for r in range(rounds):
        def signed(*v):
            h = spark_hash(*v)
            return h - (1 << 64) if h >> 63 else h

        other = (signed(2 * r, *key) % size - at) % size
        if signed(2 * r + 1, *key, Long(max(at, other))) & 1:
            at = other
    return at


def spark_hash(*values):
    """xxhash64 of strings, ints (a tuple of one, which Spark hashes in four bytes) and longs."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if isinstance(v, Long) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class Long(int):
    pass


@pytest.mark.parametrize("shards", [1, 5, 64])
def test_slots_equal_brute_force(spark, shards):
    """Counts from every slot's own draw, numbers from the counts, blocks from the permutations, and each document's words from its blocks."""
    rows, df = corpus(spark)
    mix = Mix(df, block=8, shards=shards)
    plan = {r["source_no"]: r for r in mix.plan.collect()}
    total = sum(r["slots"] for r in plan.values())
    drawn = Counter()
    for k in range(total):
        u = spark_hash(10, "draw", Long(k))
        u = (u - (1 << 64) if u >> 63 else u) % total
        drawn[k % shards, next(n for n, r in plan.items() if r["first_slot"] <= u < r["first_slot"] + r["slots"])] += 1
    assert {(r["shard"], r["source_no"]): r["n"] for r in mix.drawn.collect()} == drawn
    counts = {(r["shard"], r["source_no"]): r["n"] for r in mix.counts.collect()}
    for n, r in plan.items():
        assert sum(c for (_, s), c in counts.items() if s == n) == r["slots"]
    for shard in range(shards):
        assert sum(c for (s, _), c in counts.items() if s == shard) == sum(c for (s, _), c in drawn.items() if s == shard) == len(range(shard, total, shards))
    over = sum(max(0, sum(c for (_, s), c in drawn.items() if s == n) - r["slots"]) for n, r in plan.items())
    assert sum(abs(counts.get(k, 0) - drawn[k]) for k in {*counts, *drawn}) <= 2 * over
    want, first = defaultdict(Counter), defaultdict(dict)
    for n, r in plan.items():
        j = 0
        for shard in range(shards):
            for _ in range(counts.get((shard, n), 0)):
                block = permuted(Long(j % r["blocks"]), r["blocks"], (10, n, Long(j // r["blocks"])))
                want[shard][n, int(block)] += 1
                first[n].setdefault(int(block), shard)
                j += 1
        # No block comes again before all of its source have come.
        times = Counter(b for shard in want.values() for (s, b), c in shard.items() if s == n for _ in range(c))
        assert not times or max(times.values()) - (min(times.values()) if len(times) == r["blocks"] else 0) <= 1
    slots = mix.slots().collect()
    got = defaultdict(Counter)
    for r in slots:
        got[r["shard"]][r["source_no"], r["block"]] += 1
    assert got == want
    for shard in range(shards):
        assert sorted(r["slot"] for r in slots if r["shard"] == shard) == list(range(len(range(shard, total, shards))))
    # Documents tile their source's stream; each word is taken as often as its block.
    times = Counter()
    for own in got.values():
        times.update(own)
    taken = {r["doc_id"]: (r["taken"], r["first_shard"]) for r in mix.taken().collect()}
    tiles = defaultdict(list)
    for r in mix.rows.collect():
        tiles[r["source_no"]].append((r["start"], r["size"]))
        blocks = [(r["start"] + w) // 8 for w in range(r["size"])]
        some = [first[r["source_no"]][b] for b in blocks if b in first[r["source_no"]]]
        assert taken[r["doc_id"]] == (sum(times[r["source_no"], b] for b in blocks), min(some, default=None))
    for n, own in tiles.items():
        at = 0
        for start, size in sorted(own):
            assert start == at
            at += size
        assert at == plan[n]["source_size"]
    words = {r["doc_id"]: r["n"] for r in mix.mixture().groupBy("doc_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()}
    assert words == {i: n for i, (n, _) in taken.items() if n}


def test_counts_vary_as_multinomial_ones(spark):
    rows = [(i, f"s{i % 4}", "w " * 800) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mix = Mix(df, block=4, shards=32)
    plan = {r["source_no"]: r["slots"] for r in mix.plan.collect()}
    total = sum(plan.values())
    for counts in (mix.drawn, mix.counts):
        n = {(r["shard"], r["source_no"]): r["n"] for r in counts.collect()}
        chi = sum((n.get((s, k), 0) - total / 32 * p / total) ** 2 / (total / 32 * p / total) for s in range(32) for k, p in plan.items())
        assert 55 < chi < 140  # 93 degrees of freedom
    other = {(r["shard"], r["source_no"]): r["n"] for r in Mix(df, block=4, shards=32, seed=11).counts.collect()}
    assert other != n


def test_hot_rows_are_dealt_in_several_tasks(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z"), (2, "b", None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = df.select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    for run in (7, 1000):
        found = placed(sized, ["source"], ["doc_id", "size"], F.col("size"), "start", per_bucket=1, run=run).collect()
        assert len(found) == len(rows)
        assert sorted(r["start"] for r in found if r["doc_id"] == 1) == list(range(0, 300, 3))


def test_equal_rows_come_back_as_often_as_they_are_taken(spark):
    rows = [(1, "a", "x y z", k % 2) for k in range(60)] + [(2, "b", " ".join("pq" * 40), 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, _rid int")
    out = mixed_documents(df, block=8)
    assert out.columns == df.columns
    mix = Mix(df, block=8)
    taken = {r["doc_id"]: r["n"] for r in mix.taken().groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()} == taken
    assert {r["_rid"] for r in out.where("doc_id = 1").collect()} == {0, 1}


def test_mixed_documents_have_the_words_taken(spark):
    rows, df = corpus(spark)
    text = {i: t.split() for i, _, t in rows}
    taken = {r["doc_id"]: r["taken"] for r in Mix(df, block=8).taken().collect()}
    out = defaultdict(int)
    for r in mixed_documents(df, block=8).collect():
        words = r["text"].split()
        assert set(words) <= set(text[r["doc_id"]])
        out[r["doc_id"]] += len(words)
    assert out == {i: n for i, n in taken.items() if n}
