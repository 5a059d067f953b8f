"""Language ID: interpolated Kneser-Ney character models per language, lowest length-normalised cross-entropy, calibrated rejection."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charlm import CharModel, Words, WordScores, drawn, pieces, texts_of, train, trained, words_of
from .common import cut, lean

UNKNOWN = "und"
#: Rows of the pool that stand in each language's calibration, and costs and characters of those that stand in the pool's.
STAND_IN, PRIOR_COST, PRIOR_CHARACTERS = 10, (2.0, 4.0), 100


@dataclass
class LanguageModel:
    """bounds: by language, mean and standard deviation of the cross-entropy of calibration texts, and the variance of one character's.

    evidence: characters' worth of cross-entropy that the confidence counts at most, as neighbouring
    characters are not independent evidence.
    """

    model: CharModel | None
    bounds: np.ndarray | None = None
    limit: float = 6.0
    evidence: int = 40

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_by_word"}

    @functools.cached_property
    def _by_word(self) -> WordScores:
        def total(words: Words) -> np.ndarray:
            logs, word = self.model.characters(words)
            return np.add.reduceat(logs.astype(float), np.flatnonzero(np.diff(word, prepend=-1)), axis=0)

        return WordScores(total)

    def costs(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: cross-entropy by language in nats a character, and how many characters it has."""
        total: list[np.ndarray] = []
        characters: list[float] = []
        classes = len(self.model.classes)
        for of, part in pieces(texts):
            words = words_of(part)
            while len(total) <= of[-1]:
                total.append(np.zeros(classes))
                characters.append(0.0)
            if len(words.lengths):
                by_word, n = self._by_word(words), np.bincount(words.text, (words.lengths + 1)[words.word], len(part))
                sums = np.stack([np.bincount(words.text, by_word[words.word, k], len(part)) for k in range(classes)], axis=1)
                for i, k in enumerate(of):
                    total[k] = total[k] + sums[i]
                    characters[k] += n[i]
        n = np.array(characters)
        return -np.array(total).reshape(-1, classes) / np.maximum(n, 1)[:, None], n

    def score(self, texts) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: language, confidence 0 to 1, cross-entropy in nats a character, and whether it is accepted."""
        if self.model is None:
            n = sum(1 for _ in texts)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n, bool)
        cost, characters = self.costs(texts)
        if not len(cost):
            return [], np.zeros(0), np.zeros(0), np.zeros(0, bool)
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(cost)), best]
        sure = 1 / np.exp((least[:, None] - cost) * np.minimum(characters, self.evidence)[:, None]).sum(axis=1)
        some = characters > 0
        fine = some & (self.deviation(best, least, characters) <= self.limit)
        lang = [self.model.classes[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
        return lang, np.where(some, sure, 0.0), np.where(some, least, 0.0), fine

    def deviation(self, best: np.ndarray, cost: np.ndarray, characters: np.ndarray) -> np.ndarray:
        mean, spread, noise = self.bounds[best].T
        return (cost - mean) / np.sqrt(spread**2 + noise / np.maximum(characters, 1))


def calibrate(out: LanguageModel, lang: np.ndarray, cost: np.ndarray, characters: np.ndarray, alpha: float) -> None:
    """Sets bounds and limit from texts of known language (as a class) and their cost under its model.

    Ten rows of the pool of all languages, spread evenly by cost, stand beside each language's own, and
    ten of fixed cost beside the pool's, so that languages with few or no rows are judged by the others.
    """
    pool = np.concatenate([cost, np.linspace(*PRIOR_COST, STAND_IN)])
    size = np.concatenate([characters, np.full(STAND_IN, PRIOR_CHARACTERS)])
    spread = np.argsort(pool, kind="stable")[np.linspace(0, len(pool) - 1, STAND_IN + 2).astype(int)[1:-1]]
    out.bounds = np.zeros((len(out.model.classes), 3))
    for k in range(len(out.bounds)):
        own = np.concatenate([np.flatnonzero(lang == k), spread])
        c, n = pool[own], size[own]
        mean = np.median(c)
        out.bounds[k] = mean, max(0.02, float(np.std(c[n >= np.median(n)]))), max(1.0, float(np.mean((c - mean) ** 2 * np.minimum(n, 200))))
    if len(cost):
        out.limit = max(6.0, 1.25 * float(np.quantile(out.deviation(lang, cost, characters), 1 - alpha)))


def fit(learn: DataFrame, *, order: int = 5, most_chars: int = 3_000_000, most_total: int = 24_000_000, most_calibration: int = 1_500_000, alpha: float = 0.001, evidence: int = 40, seed: int = 2) -> LanguageModel:
    """A model of learn's (doc_id, text, lang) rows; rows without text or lang are not used, equal rows count once.

    The character models are fitted on up to most_chars characters of each language, of all languages
    together most_total at most. Rejection is calibrated with models of one half of the rows on up to
    most_calibration characters of each language in the other: the limit on the standardised
    cross-entropy is 1.25 times what all but a share alpha of them keep to, and 6 at least. No rows
    give a model that knows nothing.
    """
    rows = learn.where("text is not null and lang is not null").select(F.xxhash64("doc_id", "text").alias("rid"), "text", F.col("lang").cast("string").alias("lang"))
    sample, _ = drawn(rows, "lang", F.length("text"), most_chars, most_calibration, seed, most_total=most_total)
    sample = cut(sample)
    model, first = trained(sample.where("fits"), "lang", functools.partial(train, order=order))
    if model is None:
        return LanguageModel(None)
    out = LanguageModel(model, evidence=evidence)
    nothing = np.zeros(0)
    if first is None:
        calibrate(out, nothing, nothing, nothing, alpha)
        return out
    shared = rows.sparkSession.sparkContext.broadcast(LanguageModel(first))
    place = {c: k for k, c in enumerate(first.classes)}

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            cost, n = shared.value.costs(texts_of(batch.column(0)))
            own = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], int)
            some = np.flatnonzero((own >= 0) & (n > 0))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some)), pa.array(cost[some, own[some]]), pa.array(n[some])], ["lang", "cost", "characters"])

    got = sample.where("calibrates").select("text", "lang").mapInArrow(lean(measure), "lang string, cost double, characters double").toArrow()
    shared.destroy()
    at = {c: k for k, c in enumerate(model.classes)}
    calibrate(out, np.array([at[x] for x in got.column("lang").to_pylist()], int), got.column("cost").to_numpy(), got.column("characters").to_numpy(), alpha)
    return out


def predict(documents: DataFrame, model: LanguageModel, extra: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted of every document row, from its text alone.

    extra: named columns to carry. A null text and one without letters are `und`, score 0 and not
    accepted. Of languages with equal cross-entropy the first by name is taken. Equal texts have equal
    results. No rows give no rows.
    """
    extra = extra or {}
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            lang, sure, cost, fine = shared.value.score(texts_of(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(cost, pa.float64()), pa.array(fine, pa.bool_())], [*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy", "accepted"])

    rows = documents.select("doc_id", *[c.alias(k) for k, c in extra.items()], "text")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(score), f"{kept}, lang_pred string, score double, cross_entropy double, accepted boolean")


def accepted(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of documents whose language is accepted, with all their columns, whatever these are called.

    A null text and one without letters are rejected, equal texts stay or go together, repeated rows
    stay repeated. No rows give no rows.
    """
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(texts_of(batch.column(at)))[3], pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)
