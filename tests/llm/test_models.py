import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import langid, toxicity
from sparkloom.llm.charlm import Words, pieces, train, train_shared, words_of
from tests.llm import edges

SYLLABLES = {"aa": ["ka", "lo", "mi", "tun", "per"], "bb": ["sch", "ei", "ung", "ber", "zu"], "cc": ["oux", "elle", "tion", "é", "que"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def counted(words):
    return learned(Counter(words))


def test_probabilities_after_a_context_sum_to_one():
    model = train({"a": counted(["abab", "abba", "aab", "b"] * 3), "b": counted(["bbb", "ba"] * 2)}, 4)
    for prefix in ["", "a", "ab", "zz", "abab"]:
        total = np.zeros(2)
        for nxt in ["a", "b", None, "z"]:
            word = prefix + (nxt or "")
            logs, _ = model.characters(Words(np.frombuffer(word.encode("utf-32-le"), "<u4"), np.array([len(word)])))
            total += np.exp(logs[len(prefix)])
        assert np.allclose(total, 1, atol=1e-3)


class Plain:
    """Interpolated Kneser-Ney by its definition, in dictionaries; words with their counts, a context's symbols one by one."""

    def __init__(self, words, order, symbols):
        self.order, self.symbols = order, symbols
        self.counts = [defaultdict(float) for _ in range(order + 1)]
        before = [defaultdict(set) for _ in range(order + 2)]
        for word, n in words.items():
            s = ["^"] * (order - 1) + list(word) + ["$"]
            for at in range(order - 1, len(s)):
                for k in range(1, order + 1):
                    gram = tuple(s[at + 1 - k : at + 1])
                    self.counts[k][gram] += n
                    before[k][gram[1:]].add(gram[0])
        for k in range(1, order):
            for gram in self.counts[k]:
                if gram[0] != "^":
                    self.counts[k][gram] = len(before[k + 1][gram])
        self.discount, self.total, self.kinds = [0.0], [None], [None]
        for k in range(1, order + 1):
            ones, twos = (sum(c == n for c in self.counts[k].values()) for n in (1, 2))
            self.discount.append(min(max(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1), 0.95))
            self.total.append(Counter())
            self.kinds.append(Counter())
            for gram, c in self.counts[k].items():
                self.total[k][gram[:-1]] += c
                self.kinds[k][gram[:-1]] += 1

    def p(self, gram, k=None):
        k = self.order if k is None else k
        if not k:
            return 1 / self.symbols
        gram = gram[-k:]
        total, lower = self.total[k][gram[:-1]], self.p(gram, k - 1)
        if not total:
            return lower
        return (max(self.counts[k].get(gram, 0) - self.discount[k], 0) + self.discount[k] * self.kinds[k][gram[:-1]] * lower) / total

    def word(self, word):
        s = ["^"] * (self.order - 1) + list(word) + ["$"]
        return [self.p(tuple(s[at + 1 - self.order : at + 1])) for at in range(self.order - 1, len(s))]


def some_words(seed, n=400):
    rng = random.Random(seed)
    return {lang: Counter(prose(rng, lang, 1) for _ in range(n // (k + 1))) for k, lang in enumerate(("aa", "bb"))}, [prose(rng, lang, 1) for lang in SYLLABLES for _ in range(30)] + ["z", "kzq", "éé"]


def learned(words):
    w = words_of([" ".join(w for w, n in words.items() for _ in range(n))])
    return w, np.bincount(w.word, minlength=len(w.lengths))


def logs_of(model, word):
    return model.characters(Words(np.frombuffer(word.encode("utf-32-le"), "<u4"), np.array([len(word)])))[0]


@pytest.mark.parametrize("order", [1, 2, 4, 7])
def test_equals_kneser_ney_by_definition(order):
    words, asked = some_words(order)
    model = train({k: learned(v) for k, v in words.items()}, order)
    symbols = len({c for v in words.values() for w in v for c in w}) + 2
    for j, lang in enumerate(("aa", "bb")):
        plain = Plain(words[lang], order, symbols)
        for word in asked:
            assert np.allclose(logs_of(model, word)[:, j], np.log(plain.word(word)), atol=1e-4), word


@pytest.mark.parametrize("order,weight", [(1, 3.0), (4, 60.0), (6, 1.0)])
def test_shared_model_equals_its_definition(order, weight):
    words, asked = some_words(order)
    model = train_shared({k: learned(v) for k, v in words.items()}, order, weight)
    symbols = len({c for v in words.values() for w in v for c in w}) + 2
    base = Plain(words["aa"] + words["bb"], order, symbols)
    for j, lang in enumerate(("aa", "bb")):
        own = Plain(words[lang], order, symbols)
        for word in asked:
            s = ["^"] * (order - 1) + list(word) + ["$"]
            want = []
            for at, q in zip(range(order - 1, len(s)), base.word(word), strict=True):
                gram = tuple(s[at + 1 - order : at + 1])
                d = own.discount[order]
                want.append((max(own.counts[order].get(gram, 0) - d, 0) + (d * own.kinds[order][gram[:-1]] + weight) * q) / (own.total[order][gram[:-1]] + weight))
            assert np.allclose(logs_of(model, word)[:, j], np.log(want), atol=1e-4), word


def test_pieces_of_long_texts_give_the_same_sums():
    words, _ = some_words(3)
    model = langid.LanguageModel(train({k: learned(v) for k, v in words.items()}, 4))
    rng = random.Random(4)
    texts = [prose(rng, "aa", 60_000), None, "", prose(rng, "bb", 10), "x" * 1_000_000, "\0" * 300_000 + "ka\0lo", " " * 600_000]
    assert "".join(p for of, part in pieces(texts) for k, p in zip(of, part, strict=True) if k == 0) == texts[0]
    cost, n = model.costs(texts)
    assert n.tolist()[1:4] == [0, 0, len(texts[3].replace(" ", "")) + 10] and n[5] == 6 and n[6] == 0
    # 250,000 characters a piece, and longest words of 256 letters in it
    assert n[4] == 1_000_000 + 4 * -(-250_000 // 256)
    whole = words_of([texts[0]])
    logs, word = model.model.characters(whole)
    per = np.add.reduceat(logs.astype(float), np.flatnonzero(np.diff(word, prepend=-1)), axis=0)
    assert np.allclose(cost[0], -per[whole.word].sum(axis=0) / n[0], atol=1e-6)


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(5, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1 or doc_id < 100"), order=4)
    found = langid.predict(df, model).collect()
    assert sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in found) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in found) and sum(not r["accepted"] for r in found) <= 2
    odd = langid.predict(spark.createDataFrame([(1, "xqzwv jkqx wvvq zzxq qqwx " * 10), (2, prose(rng, "bb", 40))], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["accepted"] for r in odd} == {1: False, 2: True}
    assert langid.accepted(df, model).columns == df.columns


def test_few_documents_of_many_languages(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(df, langid.fit(df, order=3)).collect()
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] and r["accepted"] for r in found)


def test_language_id_edges(spark):
    docs = edges.documents(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs, model).collect()
    assert edges.got_ids(found) == edges.ids()
    for r in found:
        text = next(t for i, t in edges.ROWS if i == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    assert langid.predict(edges.documents(spark, []), model).count() == 0
    nothing = langid.fit(edges.documents(spark, []).select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, rng.choice(["aa", "bb"]), rng.randint(20, 200)).split()
        if i % 5 == 0:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["moron", "scum", "wretch" + rng.choice(SYLLABLES["aa"])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    texts, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(texts.where("doc_id % 4 <> 2"), marks)
    found = {r["doc_id"]: r for r in toxicity.predict(texts, model).collect()}
    held = [i for i in range(500) if i % 4 == 2]
    right = sum(found[i]["predicted"] == int(i % 5 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert toxicity.ordinary(texts, model).count() == sum(not r["predicted"] for r in found.values())


def test_toxicity_edges(spark):
    docs = edges.documents(spark)
    marks = spark.createDataFrame([(0, 0), (9, 1), (6, 0), (6, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs, marks), toxicity.fit(docs, marks.where("toxic = 0")), toxicity.fit(docs, marks.where("toxic > 5"))):
        found = toxicity.predict(docs, model).collect()
        assert edges.got_ids(found) == edges.ids()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
        assert next(r["score"] for r in found if r["doc_id"] == 1) == 0
    assert toxicity.predict(edges.documents(spark, []), model).count() == 0
