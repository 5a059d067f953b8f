import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import katz
from sparkloom.llm.katz import score_documents
from tests.llm import edges
from tests.llm.katz_model import Katz


def check(found, rows, model):
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        n, known, base, score = model.score(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, model.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(score, rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("fragments", [1, 4, 16])
def test_equals_brute_force(spark, fragments, monkeypatch):
    monkeypatch.setattr(katz, "BATCH", 500)
    rng = random.Random(fragments)
    vocabulary = [f"W{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = Katz([t for i, t in rows if i % 3])
    check(score_documents(df, F.col("doc_id") % 3 == 0, fragments).collect(), rows, model)
    for h in [*list(model.after)[:20], "<s>"]:
        assert sum(model.p(w, h) for w in model.c) + model.p("unknown word", h) == pytest.approx(1, abs=1e-9)


def test_hot_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(katz, "BATCH", 200)
    monkeypatch.setattr(katz, "FRAGMENT", 300)
    rng = random.Random(9)
    rows = [(i, " ".join("the" if rng.random() < 0.5 else f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 40)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    kept = katz._Spread.__init__
    monkeypatch.setattr(katz._Spread, "__init__", lambda self, *a: (kept(self, *a), seen.append(max(map(len, self.keys))))[0])
    check(score_documents(df, F.col("doc_id") % 7 == 2, 4).collect(), rows, Katz([t for i, t in rows if i % 7 != 2]))
    assert seen[0] > 4


def test_edges(spark):
    rows = edges.ROWS
    found = score_documents(edges.documents(spark), F.col("doc_id") == 8).collect()
    assert edges.got_ids(found) == edges.ids()
    check(found, rows, Katz([t for i, t in rows if i != 8]))
    assert score_documents(edges.documents(spark, []), F.lit(False)).count() == 0
    untrained = score_documents(edges.documents(spark), F.lit(True)).collect()
    assert len(untrained) == len(rows) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)
