"""Toxicity by class-conditional Kneser-Ney models: length-normalised toxic against ordinary log-likelihoods.

Both classes are character models over words that share their backoff counts. A word's toxic
log-likelihood is compared with its ordinary one; as a long document may be toxic in a few words
only, a word counts by what its ratio is over `least` nats. The document's ratio is the sum over its
words divided by their number (and `rest` words that say nothing, so that one odd word does not
carry a short text). The ratio alone gives the score, by a logistic fit on labelled rows that the
models have not seen.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charlm import SharedModel, Words, WordScores, drawn, pieces, texts_of, train_shared, trained, words_of
from .common import cut, join_small, lean

#: Ratios are compared by the log of what they are over this.
STEP = 1e-3


@dataclass
class ToxicityModel:
    """least: nats that a word's ratio has to be over. rest: words added to a text's length. slope, offset: of the logistic."""

    model: SharedModel | None
    least: float = 1.0
    rest: int = 50
    slope: float = 0.0
    offset: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_by_word"}

    @functools.cached_property
    def _by_word(self) -> WordScores:
        def over(words: Words) -> np.ndarray:
            logs, word = self.model.characters(words)
            ratio = np.add.reduceat(logs[:, 1] - logs[:, 0], np.flatnonzero(np.diff(word, prepend=-1)))
            return np.maximum(ratio - self.least, 0.0)

        return WordScores(over)

    def ratios(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: its length-normalised ratio, and its words."""
        total: list[float] = []
        count: list[int] = []
        for of, part in pieces(texts):
            words = words_of(part)
            while len(total) <= of[-1]:
                total.append(0.0)
                count.append(0)
            if len(words.lengths):
                sums = np.bincount(words.text, self._by_word(words)[words.word], len(part))
                n = np.bincount(words.text, minlength=len(part))
                for i, k in enumerate(of):
                    total[k] += sums[i]
                    count[k] += int(n[i])
        n = np.array(count, int)
        return np.array(total) / np.maximum(n + self.rest, 1), n

    def score(self, texts) -> np.ndarray:
        """Probability of each text to be toxic; 0 for a text without letters."""
        if self.model is None:
            return np.zeros(sum(1 for _ in texts))
        ratio, n = self.ratios(texts)
        z = self.slope * np.log(ratio + STEP) + self.offset
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit; a row of no evidence that is ordinary and one of strong evidence that is toxic stand beside the rows, so that it is defined for any."""
    x = np.concatenate([x, np.log([STEP, 1.0])])
    y, weight = np.concatenate([y, [0.0, 1.0]]), np.concatenate([weight, [1.0, 1.0]])
    rows, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)

    def loss(w):
        z = rows @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-3 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        grad = rows.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(
    texts: DataFrame, labels: DataFrame, *, order: int = 6, weight: float = 60.0, least: float = 1.0, rest: int = 50, most_chars: int = 4_000_000, most_calibration: int = 6_000_000, most_docs: int = 40_000, seed: int = 3
) -> ToxicityModel:
    """A model of the (doc_id, text) rows of texts that labels (doc_id, toxic) mark; rows without text or label are not used, of several labels the highest holds, equal rows count once.

    The character models are fitted on up to most_chars characters, and most_docs rows, of each class.
    The logistic is fitted with models of one half of the rows on up to most_calibration characters
    of each class in the other, each row weighted by how many of its class it stands for, so that the
    classes count as they are mixed whatever the limit. weight: of the shared counts. Without rows of
    both classes nothing is toxic.
    """
    spark = texts.sparkSession
    texts = texts.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Samples are drawn among hashes and lengths, so that no text is shuffled; what is drawn is as bounded as the sample.
    rows = cut(texts.select("doc_id", "rid", F.length("text").alias("chars")).join(marks, "doc_id").groupBy("rid").agg(F.max("toxic").alias("toxic"), F.max("chars").alias("chars")))
    ids, whole = drawn(rows, "toxic", F.col("chars"), most_chars, most_calibration, seed, most_docs)
    sample = cut(join_small(texts.select("rid", "text"), cut(ids.drop("chars")), "rid"))
    model, first = trained(sample.where("fits"), "toxic", functools.partial(train_shared, order=order, weight=weight))
    if model is None or model.classes != ["0", "1"]:
        return ToxicityModel(None)
    out = ToxicityModel(model, least, rest)
    ratio, y, by = np.zeros(0), np.zeros(0), np.zeros(0)
    if first is not None and first.classes == ["0", "1"]:
        shared = spark.sparkContext.broadcast(ToxicityModel(first, least, rest))

        def measure(batches):
            import pyarrow as pa

            for batch in batches:
                own, n = shared.value.ratios(texts_of(batch.column(1)))
                some = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(own[some])], ["toxic", "ratio"])

        got = sample.where("calibrates").select("toxic", "text").mapInArrow(lean(measure), "toxic int, ratio double").toArrow()
        shared.destroy()
        y, ratio = got.column("toxic").to_numpy().astype(float), got.column("ratio").to_numpy()
        by = np.where(y > 0, whole.get(1, 0) / max(1.0, y.sum()), whole.get(0, 0) / max(1.0, len(y) - y.sum()))
    out.slope, out.offset = logistic(np.log(ratio + STEP), y, by)
    return out


def predict(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3, extra: dict | None = None) -> DataFrame:
    """doc_id, the extra columns, score and predicted of every document row, from its text alone.

    Null and empty texts, and texts without letters, score 0. Equal texts have equal scores. A score of
    exactly the threshold is toxic. No rows give no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            s = shared.value.score(texts_of(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    rows = documents.select("doc_id", *[c.alias(k) for k, c in (extra or {}).items()], "text")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(score), f"{kept}, score double, predicted int")


def ordinary(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of documents below the threshold, with all their columns, whatever these are called.

    Null and empty texts stay, equal texts stay or go together, repeated rows stay repeated. No rows
    give no rows.
    """
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(texts_of(batch.column(at))) < threshold, pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)
