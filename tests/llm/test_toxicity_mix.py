"""Scores keep the classes' true mix when the calibration limit draws them at different rates."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import toxicity
from tests.llm.test_models import prose


def test_score_is_the_same_with_a_small_and_a_large_calibration(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        words = prose(rng, "aa", 10).split()
        if rng.random() < (0.6 if i % 10 == 0 else 0.1):
            words[rng.randrange(len(words))] = "scum"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    texts, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    insulting = texts.where("text like '%scum%'")
    share = insulting.join(marks, "doc_id").agg(F.avg("toxic")).first()[0]
    assert 0.3 < share < 0.5
    for most in (6_000_000, 10_000):
        model = toxicity.fit(texts, marks, most_calibration=most)
        assert toxicity.predict(insulting, model).agg(F.avg("score")).first()[0] == pytest.approx(share, abs=0.12), most
        assert toxicity.predict(texts, model).agg(F.avg("score")).first()[0] == pytest.approx(0.1, abs=0.03), most
