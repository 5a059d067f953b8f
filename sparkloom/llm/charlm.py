"""Interpolated Kneser-Ney character models of several classes over words, kept in sorted hash arrays.

A text is its words: runs of letters of the lower-cased text, longer runs in pieces of LONGEST. A
word's characters are predicted from up to order - 1 characters of the same word and its start, so a
word's log-probability does not depend on its neighbours and each distinct word is scored once.

For each order a model holds the sorted 64-bit hashes of the n-grams that any class has seen, with
a column of log-probabilities per class (for a class that has not seen the n-gram, its backed-off
value), and the sorted hashes of contexts with a column of log backoff weights per class. In a shared
model all orders are those of all classes together, and each class adds its own discounted counts
of the highest order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Symbols for what stands before and after a word's letters.
START, END = 1, 2
#: Letters of the longest word; a longer run of letters is several words.
LONGEST = 256

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche."""
    x = x.astype(U64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(by)
    return x ^ (x >> U64(31))


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _LETTER


@dataclass
class Words:
    """The distinct words of some texts: letters one after another, lengths, hashes, and of each word token its word and text."""

    letters: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    word: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    text: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def take(self, rows: np.ndarray) -> Words:
        """Some of the distinct words, without tokens."""
        first = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[rows]
        at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Words(self.letters[at], n, self.hashes[rows])


def pieces(texts: Iterable[str | None], most: int = 250_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of pieces of texts with about so many characters each, as (each piece's text, pieces).

    A longer text is cut, at a space if there is one in the last 10,000 characters of a piece, so that
    the memory of vectorised code is bounded whatever a text's length. null is the empty text.
    """
    of: list[int] = []
    held: list[str] = []
    size = 0
    for k, t in enumerate(texts):
        t, at = t or "", 0
        while True:
            end = len(t)
            if end - at > most:
                space = t.rfind(" ", at + most - 10_000, at + most)
                end = space + 1 if space >= 0 else at + most
            of.append(k)
            held.append(t[at:end])
            size += end - at
            at = end
            if size >= most:
                yield np.array(of), held
                of, held, size = [], [], 0
            if at >= len(t):
                break
    if held:
        yield np.array(of), held


def texts_of(column, step: int = 256) -> Iterator[str | None]:
    """The values of an Arrow column of strings, of which few are Python's at a time."""
    for k in range(0, len(column), step):
        yield from column.slice(k, step).to_pylist()


def words_of(texts: list[str | None]) -> Words:
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\0".join(lower).encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return Words(np.zeros(0, np.uint32), np.zeros(0, int))
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), starts, side="right")
    own, lengths = codes[letter], ends - starts
    if lengths.max() > LONGEST:
        parts = -(-lengths // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        text, lengths = np.repeat(text, parts), np.minimum(np.repeat(lengths, parts) - nth * LONGEST, LONGEST)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(own)) - np.repeat(first, lengths)
    by = mix(np.arange(1, int(lengths.max()) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    hashes = mix(np.add.reduceat((own.astype(U64) + U64(3)) * by[place], first))
    kinds, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    n = lengths[at]
    take = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Words(own[take], n, kinds, word, text)


class WordScores:
    """Values of distinct words, of which those scored so far are kept, up to `most` words: most words of a text have come before."""

    def __init__(self, score: Callable[[Words], np.ndarray], most: int = 200_000):
        self.score, self.most = score, most
        self.keys, self.values = np.zeros(0, U64), None

    def __call__(self, words: Words) -> np.ndarray:
        at, hit = _find(self.keys, words.hashes)
        if self.values is not None and hit.all():
            return self.values[at]
        missing = np.flatnonzero(~hit)
        fresh = self.score(words.take(missing))
        out = np.zeros((len(hit), *fresh.shape[1:]), fresh.dtype)
        out[missing] = fresh
        if self.values is not None:
            out[hit] = self.values[at[hit]]
        if len(self.keys) + len(missing) > self.most:
            self.keys, self.values = words.hashes, out
        else:
            keys = np.concatenate([self.keys, words.hashes[missing]])
            values = fresh if self.values is None else np.concatenate([self.values, fresh])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        return out


def grams(words: Words, order: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For n = 1 to order, at every predicted character: hash of the n-gram, of its context, whether it begins with START; and each one's word."""
    n = words.lengths + order  # order - 1 starts, the letters, the end
    first = np.cumsum(n) - n
    s = np.full(int(n.sum()), START, U64)
    word = np.repeat(np.arange(len(n)), words.lengths + 1)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(words.lengths + 1) - words.lengths - 1, words.lengths + 1)
    at = first[word] + order - 1 + inner
    last = inner == words.lengths[word]
    s[at[~last]] = words.letters
    s[at[last]] = END
    by = mix(np.arange(1, order + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
    full = np.zeros_like(s)
    hashes, contexts, begins = [], [], []
    for k in range(order):
        before = full
        full = before + np.concatenate([np.zeros(k, U64), s[: len(s) - k]]) * by[k]
        hashes.append(full[at])
        contexts.append(before[at - 1] if k else np.zeros(len(at), U64))
        begins.append(s[at - k] == START)
    return hashes, contexts, begins, word


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def discount_of(c: np.ndarray) -> float:
    """Kneser-Ney's absolute discount of counts, within 0.1 and 0.95."""
    ones, twos = (c == 1).sum(), (c == 2).sum()
    return min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95)


class _Positions:
    """The predicted characters of counted words, of which one order's hashes are held at a time."""

    def __init__(self, words: Words, counts: np.ndarray, order: int):
        n = words.lengths + order
        first = np.cumsum(n) - n
        ends = words.lengths + 1
        word = np.repeat(np.arange(len(n), dtype=np.int32), ends)
        inner = np.arange(len(word)) - np.repeat(np.cumsum(ends) - ends, ends)
        self.order, self.at = order, first[word] + order - 1 + inner
        self.symbols = np.full(int(n.sum()), START, U64)
        last = inner == words.lengths[word]
        self.symbols[self.at[~last]] = words.letters
        self.symbols[self.at[last]] = END
        self.times = counts[word].astype(float)
        self.by = mix(np.arange(1, order + 1, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)

    def _sums(self, n: int) -> np.ndarray:
        out = np.zeros_like(self.symbols)
        for k in range(n):
            out[k:] += self.symbols[: len(out) - k] * self.by[k]
        return out

    def table(self, k: int) -> dict[str, np.ndarray]:
        """The n-grams of order k + 1 with Kneser-Ney counts, discounted, and what their contexts leave."""
        before = self._sums(k)
        g, at, inverse = np.unique((before + np.concatenate([np.zeros(k, U64), self.symbols[: len(self.symbols) - k]]) * self.by[k])[self.at], return_index=True, return_inverse=True)
        context = before[self.at[at] - 1] if k else np.zeros(len(g), U64)
        del before
        begin = self.symbols[self.at[at] - k] == START
        c = np.bincount(inverse, self.times, len(g))
        if k + 1 < self.order:  # n-grams that more can stand before count what stands before them
            longer = np.unique(self._sums(k + 2)[self.at], return_index=True)[1]
            c = np.where(begin, c, np.maximum(np.bincount(inverse[longer], minlength=len(g)), 1))
        del inverse
        suffix = self._sums(k)[self.at[at]] if k else g
        less = np.minimum(c, discount_of(c))
        ctx, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, c, len(ctx))
        weights = (np.bincount(of, less, len(ctx)) / total).astype(np.float32)
        return {"gram": g, "context": context, "suffix": suffix, "rich": ((c - less) / total[of]).astype(np.float32), "contexts": ctx, "weights": weights}


@dataclass
class CharModel:
    """See the module. classes: names of the columns. floor: log-probability of a character that no class has seen."""

    order: int
    classes: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray

    def characters(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability by class of each predicted character of the distinct words, and each one's word."""
        hashes, contexts, _, word = grams(words, self.order)
        out = np.zeros((len(word), len(self.classes)), np.float32)
        left = np.arange(len(word))
        for k in range(self.order - 1, -1, -1):
            at, hit = _find(self.grams[k], hashes[k][left])
            out[left[hit]] += self.logs[k][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if k:
                at, known = _find(self.contexts[k], contexts[k][left])
                out[left[known]] += self.weights[k][at[known]]
            else:
                out[left] += self.floor
        return out, word


def train(counted: dict[str, tuple[Words, np.ndarray]], order: int) -> CharModel:
    """A model of the classes' counted words."""
    classes = sorted(counted)
    own = {c: _Positions(*counted[c], order) for c in classes}
    symbols = len(np.unique(np.concatenate([np.unique(own[c].symbols[own[c].at]) for c in classes]))) + 1  # and one that is not known
    model = CharModel(order, classes, [], [], [], [], np.zeros(len(classes), np.float32))
    told = []
    for k in range(order):
        tables = [own[c].table(k) for c in classes]
        union, at = np.unique(np.concatenate([t["gram"] for t in tables]), return_index=True)
        context = np.concatenate([t["context"] for t in tables])[at]
        suffix = np.concatenate([t["suffix"] for t in tables])[at]
        contexts = np.unique(np.concatenate([t["contexts"] for t in tables]))
        logs = np.zeros((len(union), len(classes)), np.float32)
        weights = np.zeros((len(contexts), len(classes)), np.float32)
        at_context = np.searchsorted(contexts, context)
        for j, t in enumerate(tables):
            weights[np.searchsorted(contexts, t["contexts"]), j] = np.log(t["weights"])
            share = np.exp(weights[at_context, j])
            lower = np.exp(model.logs[k - 1][np.searchsorted(model.grams[k - 1], suffix), j]) if k else np.full(len(union), 1 / symbols)
            if not k:
                model.floor[j] = np.log(share[0] / symbols)
            rich = np.zeros(len(union))
            rich[np.searchsorted(union, t["gram"])] = t["rich"]
            logs[:, j] = np.log(rich + share * lower)
        model.grams.append(union)
        model.logs.append(logs.astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(weights.astype(np.float32))
        told.append((weights < 0).any(axis=1))
    for k, some in enumerate(told):
        model.contexts[k], model.weights[k] = model.contexts[k][some], model.weights[k][some]
    return model


@dataclass
class SharedModel:
    """Classes over one shared model: p(x | h) = (max(c(hx) - d, 0) + (d n(h) + weight) q(x | h)) / (c(h) + weight).

    c and n are a class's counts and kinds after the context h of the highest order, d its discount and
    q the interpolated Kneser-Ney model of all classes' counts together. An expression that is rare in
    a class is smoothed by what all classes count, so it hardly tells them apart. own: per class grams,
    their discounted counts, contexts, their totals, and what each leaves to q.
    """

    base: CharModel
    classes: list[str]
    weight: float
    own: list[tuple[np.ndarray, ...]]

    def characters(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability by class of each predicted character of the distinct words, and each one's word."""
        logs, word = self.base.characters(words)
        q = np.exp(logs[:, 0].astype(float))
        hashes, contexts, _, _ = grams(words, self.base.order)
        out = np.zeros((len(word), len(self.classes)))
        for j, (kinds, rich, before, total, left) in enumerate(self.own):
            at, hit = _find(kinds, hashes[-1])
            c = np.where(hit, rich[at] if len(rich) else 0.0, 0.0)
            at, hit = _find(before, contexts[-1])
            n, rest = np.where(hit, total[at] if len(total) else 0.0, 0.0), np.where(hit, left[at] if len(left) else 0.0, 0.0)
            out[:, j] = np.log((c + (rest + self.weight) * q) / (n + self.weight))
        return out, word


def train_shared(counted: dict[str, tuple[Words, np.ndarray]], order: int, weight: float) -> SharedModel:
    """A shared model of the classes' counted words; see SharedModel."""
    classes = sorted(counted)
    letters = np.concatenate([counted[c][0].letters for c in classes])
    lengths = np.concatenate([counted[c][0].lengths for c in classes])
    base = train({"": (Words(letters, lengths), np.concatenate([counted[c][1] for c in classes]))}, order)
    own = []
    for c in classes:
        words, counts = counted[c]
        hashes, contexts, _, word = grams(words, order)
        kinds, at, inverse = np.unique(hashes[-1], return_index=True, return_inverse=True)
        times = np.bincount(inverse, counts[word].astype(float), len(kinds))
        before, of = np.unique(contexts[-1][at], return_inverse=True)
        d = discount_of(times)
        own.append((kinds, times - np.minimum(times, d), before, np.bincount(of, times), np.bincount(of, np.minimum(times, d))))
    return SharedModel(base, classes, weight, own)


def half_of(rid: str = "rid") -> Column:
    """Whether a row is of the half that models for calibration are fitted on; the other half calibrates."""
    return F.pmod(F.xxhash64(F.lit("half"), rid), F.lit(2)) == 0


def drawn(rows: DataFrame, label: str, chars: Column, most_chars: int, most_calibration: int, seed: int, most_docs: int = 40_000, most_total: int = 24_000_000) -> tuple[DataFrame, dict]:
    """rows with fits and calibrates, of which one is true: what a model is fitted on and what calibrates it; and of the calibrating half how many rows each label has.

    rows has rid, a hash of id and text by which alone a row is drawn, and label. About most_chars
    characters of each label are drawn to fit on, about most_calibration to calibrate, and most_docs
    rows at most, or all where a label has fewer; rows that are equal may all be drawn. Labels share
    most_total characters, so a sample is bounded however many labels there are. Nothing else is sampled.
    """
    rows = rows.withColumn("half", half_of())
    sizes = rows.groupBy(label, "half").agg(F.sum(chars).alias("chars"), F.count("*").alias("docs")).collect()  # two rows a label
    labels = {r[label] for r in sizes}

    def share(most: int, halves: tuple) -> Column:
        most = min(most, most_total / max(1, len(labels)))
        part: Column = F.lit(0.0)
        for v in labels:
            own = [r for r in sizes if r[label] == v and r["half"] in halves]
            docs, n = sum(r["docs"] for r in own), sum(r["chars"] or 0 for r in own)
            part = F.when(F.col(label).eqNullSafe(F.lit(v)), F.lit(min(1.0, most / max(1, n), most_docs / max(1, docs)))).otherwise(part)
        return part * (1 << 20)

    fits = F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(1 << 20)) < share(most_chars, (True, False))
    calibrates = ~F.col("half") & (F.pmod(F.xxhash64(F.lit(seed + 1), "rid"), F.lit(1 << 20)) < share(most_calibration, (False,)))
    return rows.withColumn("fits", fits).withColumn("calibrates", calibrates).where("fits or calibrates"), {r[label]: r["docs"] for r in sizes if not r["half"]}


def counted(labels: list[str], words: list[str], counts: np.ndarray) -> dict[str, tuple[Words, np.ndarray]]:
    """Words and their counts by label; a word may come several times."""
    out = {}
    names = np.array(labels, dtype=object)
    for c in sorted(set(labels)):
        total: dict[str, int] = {}
        for k in np.flatnonzero(names == c):
            total[words[k]] = total.get(words[k], 0) + int(counts[k])
        own = sorted(total.items())
        letters = np.frombuffer("".join(w for w, _ in own).encode("utf-32-le", "replace"), "<u4")
        out[c] = (Words(letters, np.array([len(w) for w, _ in own])), np.array([n for _, n in own]))
    return out


def trained(sample: DataFrame, label: str, fit: Callable[[dict[str, tuple[Words, np.ndarray]]], object]) -> list:
    """What fit makes of a bounded sample's counted words by label: of all of them, and of those of the fitting half; None of no words.

    sample has rid, half, label and text; rows that are equal count once. One task does it, not the
    driver, which gets the finished tables only.
    """

    def run(batches):
        import pyarrow as pa

        labels, halves, words, counts = [], [], [], []
        for batch in batches:
            labels.append(batch.column(0).to_numpy(zero_copy_only=False))
            halves.append(batch.column(1).to_numpy(zero_copy_only=False))
            words += batch.column(2).to_pylist()
            counts.append(batch.column(3).to_numpy())
        if not words:
            return
        labels, halves, counts = np.concatenate(labels), np.concatenate(halves), np.concatenate(counts)
        for which in (np.arange(len(words)), np.flatnonzero(halves)):
            model = pickle.dumps(fit(counted(labels[which].tolist(), [words[k] for k in which], counts[which]))) if len(which) else None
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    once = sample.groupBy("rid", "half", F.col(label).cast("string").alias("label")).agg(F.first("text").alias("text"))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{1,{LONGEST}}}"), F.lit(0)))
    rows = once.select("label", "half", words.alias("word")).groupBy("label", "half", "word").count()
    got = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    return [pickle.loads(r["model"]) if r["model"] else None for r in got] or [None, None]
