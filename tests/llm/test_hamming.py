import random

import numpy as np
import pytest

from sparkloom.llm.hamming import segments_for, sign_codes, top_k


def brute(codes, queries, k):
    out = set()
    for q, c in set(queries):
        others = list(codes)
        others.remove((q, c))
        best = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in others)[:k]
        out |= {(q, r + 1, i, d, n) for n, (r, (d, i)) in enumerate(enumerate(best))}
    return {(q, r, i, d) for q, r, i, d, _ in out}


@pytest.mark.parametrize("segments", [None, 2, 4, 8, 16])
def test_equals_brute_force(spark, segments):
    rng = random.Random(segments or 0)
    centers = [rng.getrandbits(63) for _ in range(3)]
    codes = [(i, centers[i % 3] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(4)))) for i in range(300)]
    codes += [(300 + i, centers[0]) for i in range(120)] + [(5, codes[5][1])]  # a hot code, a repeated row
    df = spark.createDataFrame(codes, "vec_id long, code long")
    queries = [c for c in codes if c[0] % 40 == 0]
    if segments == 2:
        queries = queries[:2]
    found = top_k(df, spark.createDataFrame(queries, "vec_id long, code long"), 7, segments, sample=50).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in found} == brute(codes, queries, 7)


def test_few_rows_and_none(spark):
    codes = spark.createDataFrame([(0, 1), (100, 3)], "vec_id long, code long")
    assert sorted(map(tuple, top_k(codes, codes, 5).collect())) == [(0, 1, 100, 1), (100, 1, 0, 1)]
    none = codes.where("vec_id < 0")
    assert top_k(none, none, 5).count() == 0


def test_codes_of_odd_vectors(spark):
    rows = [(0, [1.0, -1.0, float("nan"), None, 2.0], "c"), (1, None, "c"), (None, [1.0], "c"), (2, [], "c"), (3, [1.0] * 64, "c")]
    got = {r["vec_id"]: r["code"] for r in sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")).collect()}
    assert got == {0: 0b10001, 2: 0, 3: -1}


def test_segments_follow_size():
    assert segments_for(10**9, 2) <= segments_for(10**4, 24)
    assert np.all([segments_for(n, 10) in (2, 4, 8, 16) for n in (1, 10**3, 10**6)])
