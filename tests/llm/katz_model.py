"""A brute-force Katz model in plain dictionaries, for tests."""

import math
import re
from collections import Counter

import numpy as np

from sparkloom.llm.katz import LEAST_KEPT, MOST_DISCOUNTED, discounts, good_turing  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), "</s>"]


class Katz:
    def __init__(self, texts):
        docs = [tokens(t) for t in texts]
        self.c = Counter(w for t in docs for w in t)
        self.pair = Counter(p for t in docs for p in zip(["<s>", *t], t))
        self.history = self.c + Counter({"<s>": len(docs)})
        top = MOST_DISCOUNTED + 2
        kinds, mass, pairs = np.zeros(top), np.zeros(top), np.zeros(top)
        for n in self.c.values():
            mass[min(n, top - 1)] += n
            if n < top:
                kinds[n] += 1
        for n in self.pair.values():
            if n < top:
                pairs[n] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d = discounts(self.n, self.v, mass, kinds, pairs)
        self.after = {}
        for (h, w), n in self.pair.items():
            if n >= LEAST_KEPT:
                self.after.setdefault(h, {})[w] = self.d.pair[min(n, top - 1)] * n

    def word(self, w):
        n = self.c[w]
        return self.d.word[min(n, MOST_DISCOUNTED + 1)] * n / self.n if n else self.d.unknown

    def over(self, h):
        seen = sum(self.after.get(h, {}).values())
        return self.history[h] + 1 if seen > self.history[h] - 0.5 else self.history[h]

    def p(self, w, h):
        kept = self.after.get(h, {})
        if w in kept:
            return kept[w] / self.over(h)
        if not kept:
            return self.word(w)
        return self.word(w) * (1 - sum(kept.values()) / self.over(h)) / (1 - sum(map(self.word, kept)))

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), base, sum(math.log10(self.p(w, h)) for h, w in zip(["<s>", *t], t))
