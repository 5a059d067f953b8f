import numpy as np
import pytest

from sparkloom.llm.metric_join import forest, joins, link_embeddings


def brute(rows, least=0.9):
    """rows of (id, vector or None); ids are distinct."""
    ids = [i for i, _ in rows]
    v = [np.array(x, float) if x and all(c is not None and np.isfinite(c) for c in x) and any(x) else None for _, x in rows]
    near = {i: [] for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if v[i] is not None and v[j] is not None and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= least:
                near[i].append(j)
                near[j].append(i)
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[ids[i]] = (len(near[i]), min(ids[j] for j in seen))
    return out


@pytest.mark.parametrize("pivots,blocks", [(1, (5000, 5000)), (2, (20, 30)), (8, (16, 16)), (40, (50, 7)), (None, (None, None))])
def test_equals_brute_force(spark, pivots, blocks):
    rng = np.random.default_rng(pivots or 0)
    centers = rng.normal(size=(6, 12))
    rows = [(i, (centers[i % 6] + rng.normal(size=12) * (0.15 + 0.1 * (i % 4))).tolist()) for i in range(240)]
    rows += [(240 + i, rows[3][1]) for i in range(60)]  # a hot vector
    rows += [(300 + i, (centers[0] + rng.normal(size=12) * 0.02).tolist()) for i in range(60)]  # a crowded cell
    rows += [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] + [1.0] * 11), (404, [None] + [1.0] * 11), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [float("inf")] * 12)]
    df = spark.createDataFrame([(i, v, i % 3, "c") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    found = link_embeddings(df, pivots=pivots, home_block=blocks[0], member_block=blocks[1]).collect()
    want = brute(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == want and len(found) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in link_embeddings(df).collect())
    assert found == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert link_embeddings(df.where("vec_id > 5")).count() == 0


def test_one_of_two_cells_joins_them():
    for n in range(1, 12):
        for p in range(n):
            assert joins(p, p, n)
            assert all(joins(p, q, n) != joins(q, p, n) for q in range(p))
            assert abs(sum(joins(p, q, n) for q in range(n)) - 1 - (n - 1) / 2) <= 0.5


def test_forest_spans():
    rng = np.random.default_rng(0)
    for _ in range(50):
        near = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.2
        edges = forest(near)
        assert all(near[i, j] for i, j in edges) and len(edges) == len(set(edges))
        parent = {}

        def root(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for i, j in edges:
            a, b = root(("r", i)), root(("c", j))
            assert a != b
            parent[a] = b
        assert all(root(("r", i)) == root(("c", j)) for i, j in zip(*np.nonzero(near), strict=True))
