import random
import re

import numpy as np
import pytest

from sparkloom.llm import common, jaccard_join
from sparkloom.llm.fragments import pack, shingles, unpack
from sparkloom.llm.jaccard_join import jaccard_components, representatives, similar_pairs
from tests.llm import edges

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets_of(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, percent=80, by_id=True):
    """The group of each row: rows whose sets are similar and, by_id, rows with an id in common are in one."""
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            near = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
            if near or (by_id and i is not None and i == j):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sets, [root(k) for k in range(len(rows))]


def brute(rows, percent=80):
    """(id, size, component) of each row, -1 for null."""
    sets, group = groups(rows, percent)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((-1 if i is None else i, len(s), least.get(g, -1)) for (i, _), s, g in zip(rows, sets, group, strict=True))


def brute_representatives(rows, percent=80):
    """Ids of the rows that stay, -1 for null."""
    sets, group = groups(rows, percent, by_id=False)
    kept = {}
    for (i, t), s, g in zip(rows, sets, group, strict=True):
        key = g if s else (i, t)
        kept[key] = min((i is None, i or 0), kept.get(key, (True, 1 << 62)))
    return sorted(-1 if none else i for none, i in kept.values())


def run(spark, rows, **settings):
    found = jaccard_components(edges.documents(spark, rows, ("key", "node", "n", "token")), **settings).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found)


@pytest.mark.parametrize("seed,most_nodes", [(0, 4096), (1, 4096), (2, 0), (3, 25)])
def test_equals_brute_force(spark, seed, most_nodes, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RUN", 8)
    monkeypatch.setattr(jaccard_join, "MOST_NODES", most_nodes)  # larger clusters are joined by pairs of candidates
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.randint(6, 90))] for _ in range(12)]
    rows = []
    for i in range(180):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += passage
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(bases[0][:k])) for i, k in enumerate((0, 1, 3, 4, 5))] + [(3, rows[3][1])]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, edges.ROWS) == brute(edges.ROWS)
    assert run(spark, []) == []


def test_one_id_with_two_texts_ties_their_groups(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [(5, a), (5, b), (7, a), (2, b), (9, "other words here")]
    assert run(spark, rows) == brute(rows)
    rows += [(5, " ".join(f"c{k}" for k in range(20))), (4, " ".join(f"c{k}" for k in range(20)))]
    assert run(spark, rows) == brute(rows)


def test_null_ids_reach_and_are_reached(spark):
    w = [f"w{k}" for k in range(60)]
    near = [" ".join(w[k : k + 50]) for k in (0, 3, 6)]  # neighbours are similar, the ends are not
    rows = [(8, near[0]), (None, near[1]), (4, near[2]), (None, "quite another text of words"), (None, "quite another text of words")]
    assert brute(rows)[-1] == (8, 46, 4)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_representatives(spark, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(40)] for _ in range(6)]
    rows = list(edges.ROWS)
    for _ in range(60):
        w = list(rng.choice(base))
        w[rng.randrange(40)] = f"x{rng.randrange(5)}"
        rows.append((rng.choice([None, *range(100, 140)]), " ".join(w)))
    docs = edges.documents(spark, rows, ("_rid", "_nth", "component"))
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert edges.got_ids(kept.collect()) == brute_representatives(rows)
    assert representatives(edges.documents(spark, [])).count() == 0


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(one_task)
    pairs = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1300)] + [(7777, 7777)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            k = todo.pop()
            if k not in want:
                want[k] = start
                todo += near[k]
    found = common.components(spark.createDataFrame(pairs, "a long, b long").repartition(5), one_task=one_task).collect()
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_shingles_and_packing():
    tokens, sizes = shingles(["A b c d e f", None, "", "x y", "a B c d e f"])
    assert sizes.tolist() == [2, 0, 0, 1, 2] and tokens[:2].tolist() == tokens[3:].tolist()
    assert unpack(pack(tokens, 7), 7).tolist() == tokens.tolist()


def test_overlaps_of_fragments_sum_up():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)]
    sets += [s[: max(1, len(s) - 5)] for s in sets[:10]]
    sizes = np.array([len(s) for s in sets])
    for width in (7, 64, 4096):
        near = similar_pairs(sets, sizes, 80, width)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert near[i, j] == (i != j and 100 * both >= 80 * (len(a) + len(b) - both))
