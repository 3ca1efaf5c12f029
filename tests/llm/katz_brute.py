"""Katz scores by dictionaries, to hold the operator against."""

import math
import zlib
from collections import Counter

from kinmerge.llm.katz import Discounts


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Brute:
    def __init__(self, docs, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for i, text in docs:
            if not held_out(i):
                t = self.tokens(text)
                for m in range(1, order + 1):
                    self.counts[m - 1].update(tuple(t[k : k + m]) for k in range(len(t) - m + 1))
        self.discounts = []
        for c in self.counts:
            h = sorted(Counter(c.values()).items())
            self.discounts.append(Discounts([r for r, _ in h], [n for _, n in h]))
        self.n, self.v = sum(self.counts[0].values()), len(self.counts[0])
        self.after = [{} for _ in range(order)]
        for m in range(2, order + 1):
            for g in self.counts[m - 1]:
                self.after[m - 1].setdefault(g[:-1], []).append(g[-1])

    @staticmethod
    def tokens(text):
        return [w.decode() for w in (text or "").encode().lower().split()] + [None]

    def p(self, h, w):
        if not h:
            return (self.counts[0][(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))
        m = len(h) + 1
        c = self.counts[m - 1][(*h, w)]
        if c:
            return float(self.discounts[m - 1](c)) * c / self.counts[m - 2][h]
        return self.alpha(h) * self.p(h[1:], w)

    def alpha(self, h):
        seen = self.after[len(h)].get(h)
        return (1 - sum(self.p(h, w) for w in seen)) / (1 - sum(self.p(h[1:], w) for w in seen)) if seen else 1.0

    def score(self, text):
        t = self.tokens(text)
        return sum(math.log10(self.p(tuple(t[max(0, k - self.order + 1) : k]), w)) for k, w in enumerate(t))
