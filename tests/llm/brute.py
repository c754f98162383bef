"""Plain versions of the corpus operators, for small inputs."""

import collections
import math
import re

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingle_set(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def duplicate_components(texts, percent=80):
    """{id: (set size, smallest id reachable)} of {id: text}, comparing every pair."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def discounts(counts):
    n = collections.Counter(counts)
    if not all(n[k] for k in (1, 2, 3, 4)):
        return 0.5, 0.75, 1.0
    y = n[1] / (n[1] + 2 * n[2])
    found = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


class KneserNey:
    """The interpolated bigram model of a list of texts."""

    def __init__(self, texts):
        tokens = [[*words(t), "</s>"] for t in texts]
        self.count = collections.Counter(w for t in tokens for w in t)
        self.pairs = collections.Counter(p for t in tokens for p in zip(["<s>", *t], t))
        self.before = collections.Counter(w for _, w in self.pairs)
        self.high, self.low = discounts(self.pairs.values()), discounts(self.before.values())
        self.total, self.classes = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for (u, _), n in self.pairs.items():
            self.total[u] += n
            self.classes[u][min(n, 3) - 1] += 1
        self.left = sum(self.low[min(n, 3) - 1] for n in self.before.values()) / max(len(self.pairs), 1)

    def lower(self, w):
        n = self.before[w]
        return (max(n - self.low[min(n, 3) - 1], 0) / len(self.pairs) if n else 0) + self.left / (len(self.count) + 1)

    def chance(self, u, w):
        if not self.total[u]:
            return self.lower(w)
        n = self.pairs[u, w]
        more = max(n - self.high[min(n, 3) - 1], 0) if n else 0
        return more / self.total[u] + sum(d * k for d, k in zip(self.high, self.classes[u])) / self.total[u] * self.lower(w)

    def score(self, text):
        t = [*words(text), "</s>"]
        return sum(math.log10(self.chance(u, w)) for u, w in zip(["<s>", *t], t))

    def base(self, text):
        n, v = sum(self.count.values()), len(self.count)
        return sum(math.log10((self.count[w] + 1) / (n + v + 1)) for w in [*words(text), "</s>"])
