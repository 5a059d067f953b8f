"""Katz against a model that keeps every bigram, whatever the module's own cutoff."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.katz import MOST_DISCOUNTED, score_documents
from tests.llm.katz_model import Katz
from tests.llm.test_katz import check


class Whole(Katz):
    def __init__(self, texts):
        super().__init__(texts)
        self.after = {}
        for (h, w), n in self.pair.items():
            self.after.setdefault(h, {})[w] = self.d.pair[min(n, MOST_DISCOUNTED + 1)] * n


def test_bigrams_seen_once_are_known(spark):
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(60)]
    model = Whole([t for i, t in rows if i % 3])
    once = {p for p, n in model.pair.items() if n == 1}
    (h, w) = next(p for p in sorted(once) if p[0] != "<s>" and p[1] != "</s>")
    assert model.p(w, h) == pytest.approx(model.d.pair[1] / model.over(h))
    rows += [(300, f"{h} {w}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(score_documents(df, F.col("doc_id") % 3 == 0, 4).collect(), rows, model)
