from sparkloom.llm.encode import ids
from sparkloom.llm.queries import byte_bpe
from sparkloom.llm.token_counts import at_limits, length_histogram, limits, quantiles
from tests.llm import edges


def test_every_limit_equals_brute_force(spark):
    n = [len(ids(byte_bpe(), t)) for _, t in edges.ROWS]
    table = limits(length_histogram(edges.documents(spark), byte_bpe()))
    found = table.collect()
    assert sorted(r["context_limit"] for r in found) == sorted(set(n))
    for r in found:
        at = r["context_limit"]
        assert r["docs_at"] == n.count(at) and r["docs_total"] == len(n) and r["tokens_total"] == sum(n)
        assert r["docs_over"] == sum(x > at for x in n) and r["tokens_over"] == sum(x for x in n if x > at)
        assert r["truncated_total"] == sum(min(x, at) for x in n)
        assert abs(r["share_within"] - sum(x <= at for x in n) / len(n)) < 1e-12
    asked = (0.0001, 0.25, 0.5, 0.9, 1.0)
    assert {r["share"]: r["context_limit"] for r in quantiles(table, asked).collect()} == {q: next(x for x in sorted(n) if sum(y <= x for y in n) >= q * len(n)) for q in asked}


def test_any_limit_equals_brute_force(spark):
    n = [len(ids(byte_bpe(), t)) for _, t in edges.ROWS]
    wanted = [0, 1, 2, 7, 8, 9, 1024, 2048, 10**9]
    found = {r["context_limit"]: r for r in at_limits(length_histogram(edges.documents(spark), byte_bpe()), wanted).collect()}
    assert sorted(found) == wanted
    for at, r in found.items():
        assert (r["docs_at"], r["docs_over"], r["tokens_over"]) == (n.count(at), sum(x > at for x in n), sum(x for x in n if x > at))
        assert r["truncated_total"] == sum(min(x, at) for x in n) and r["docs_total"] == len(n)


def test_empty(spark):
    nothing = length_histogram(edges.documents(spark, []), byte_bpe())
    assert limits(nothing).count() == 0 and at_limits(nothing, [5]).count() == 0 and quantiles(limits(nothing), [0.5]).count() == 0
