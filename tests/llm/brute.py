"""Results from the operators' definitions, by brute force; ids must differ unless said otherwise."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import pii
from millrace.llm.kneser_ney import discounts


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def jaccard(docs, threshold=0.8, width=5):
    """(id, copy_id, class_id, n_links)."""

    def shingles(text):
        w = words(text)
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    of = {i: shingles(t) for i, t in docs}
    copy = {i: min(j for j in of if of[j] == of[i]) if of[i] else i for i in of}
    reps = sorted(set(copy.values()))
    near = {a: [b for b in reps if a != b and min(len(of[a]), len(of[b])) >= threshold * max(len(of[a]), len(of[b]), 1) and len(of[a] & of[b]) >= threshold * len(of[a] | of[b]) - 1e-9] for a in reps}
    root = {a: a for a in reps}
    while (new := {a: min([root[a], *(root[b] for b in near[a])]) for a in reps}) != root:
        root = new
    return sorted((i, copy[i], root[copy[i]], len(near[copy[i]])) for i in of)


def decontaminate(docs, items, width=10):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            parts = words(item)
            n = min(width, len(parts))
            for i in range(len(parts) - n + 1 if n else 0):
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == parts[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(item_id) if item_id is not None else "")
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def personal(text):
    """Base spans with the contract's own patterns."""
    text, found = text or "", []
    digits = lambda s: "".join(c for c in s if "0" <= c <= "9")
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0])):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


class KneserNey:
    """The language model as dictionaries of token tuples."""

    def __init__(self, texts, order=2):
        self.order, self.count, self.ngrams = order, Counter(), [Counter() for _ in range(order + 1)]
        for t in texts:
            w = self.split(t)
            self.count.update(w)
            padded = ["<s>"] * (order - 1) + w
            self.ngrams[order].update(tuple(padded[i : i + order]) for i in range(len(w)))
        for k in range(order, 1, -1):
            for g in self.ngrams[k]:
                self.ngrams[k - 1][g[1:]] += 1
        self.contexts = [defaultdict(list) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.ngrams[k].items():
                self.contexts[k][g[:-1]].append(c)
        self.d = [None, *([0.0, *discounts([sum(c == i for c in self.ngrams[k].values()) for i in (1, 2, 3, 4)])] for k in range(1, order + 1))]

    @staticmethod
    def split(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", low(text)), "</s>"]

    def score(self, text):
        w = self.split(text)
        padded, out = ["<s>"] * (self.order - 1) + w, 0.0
        for i in range(len(w)):
            p = 1 / (len(self.count) + 1)
            for k in range(1, self.order + 1):
                g = tuple(padded[i + self.order - k : i + self.order])
                own = self.contexts[k].get(g[:-1])
                if own:
                    c, d, total = self.ngrams[k].get(g, 0), self.d[k], sum(own)
                    p = (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in own) / total * p
            out += math.log10(p)
        return out


class Toxicity:
    """Scores from the nearest labelled texts, by dense vectors over all terms.  ``rows``: (id, text, label) of different texts."""

    def __init__(self, rows, k=15):
        self.k = k
        split = re.compile(r"[^\W\d_]+").findall
        self.words = lambda text: Counter(split((text or "").lower()))
        bags = []
        for _, text, _ in rows:
            bag = self.words(text)
            bags.append(Counter(bag))
            for w, n in bag.items():
                if len(w) > 5:
                    bags[-1]["^" + w[:5]] += n
        labels = np.array([y for _, _, y in rows])
        n, n1 = len(rows), int(labels.sum())
        n0 = n - n1
        self.vocabulary = sorted({t for b in bags for t in b})
        a = np.array([sum(t in b for b, y in zip(bags, labels, strict=True) if y) for t in self.vocabulary], float)
        b = np.array([sum(t in x for x, y in zip(bags, labels, strict=True) if not y) for t in self.vocabulary], float)
        off = a * (n0 - b) - b * (n1 - a)
        chi = n * off**2 / np.maximum((a + b) * (n - a - b) * n1 * n0, 1e-300)
        heavy = (off > 0) & (a + b >= 3) & (a + b < n) & (chi > 10.83)
        self.idf = np.append((np.log((1 + n) / (1 + a + b)) + 1) * np.where(heavy, 1, 0.02), 0.02)  # the last is for words that no example has
        self.at = {t: i for i, t in enumerate(self.vocabulary)}
        self.share = n1 / n
        groups = defaultdict(lambda: [0, 0, math.inf])
        vectors = [self.unit({self.at[t]: c for t, c in b.items()}) for b in bags]
        for (i, _, y), v in zip(rows, vectors, strict=True):
            g = groups[tuple(np.rint(v * 1e6).astype(int))]
            g[1 - y] += 1
            g[2] = min(g[2], i)
        zero = groups.pop((0,) * len(self.idf), None)
        self.w = (1 - self.share) / n0, self.share / n1
        self.zero = self.of(*zero[:2]) if zero else self.share
        order = sorted(groups.values(), key=lambda g: g[2])
        first = {i: v for (i, _, _), v in zip(rows, vectors, strict=True)}
        self.points, self.counts = np.array([first[g[2]] for g in order]), [g[:2] for g in order]
        pairs = []
        for p, (ones, noughts) in enumerate(self.counts):
            near = self.near(self.points[p], self.k + 1)
            for y, m in ((1, ones), (0, noughts)):
                if m:
                    left = [(c, self.of(*self.counts[q]) if q != p else self.of(ones - y, noughts - (1 - y))) for q, c in near if q != p or ones + noughts > 1]
                    pairs.append((self.vote(left), y, m * self.w[y]))
        votes = sorted({v for v, _, _ in pairs})
        weight = [sum(w for v, _, w in pairs if v == x) for x in votes]
        value = [sum(w for v, y, w in pairs if v == x and y) / weight[j] for j, x in enumerate(votes)]
        mean = lambda i, j: sum(v * w for v, w in zip(value[i : j + 1], weight[i : j + 1], strict=True)) / sum(weight[i : j + 1])
        fitted = [max(min(mean(i, j) for j in range(x, len(votes))) for i in range(x + 1)) for x in range(len(votes))]
        tiny, self.steps, lo = min(self.w), [], 0
        for hi in range(len(votes)):
            if hi + 1 == len(votes) or fitted[hi + 1] > fitted[hi] + 1e-12:
                total = sum(weight[lo : hi + 1])
                self.steps.append((sum(v * w for v, w in zip(votes[lo : hi + 1], weight[lo : hi + 1], strict=True)) / total, (mean(lo, hi) * total + tiny * self.share) / (total + tiny)))
                lo = hi + 1

    def of(self, ones, noughts):
        return ones * self.w[1] / max(ones * self.w[1] + noughts * self.w[0], 1e-300)

    def unit(self, counts):
        v = np.zeros(len(self.idf))
        for i, c in counts.items():
            v[i] = c * self.idf[i]
        return v / np.sqrt((v * v).sum()) if v.any() else v

    def near(self, v, k):
        cosine = np.rint(np.minimum(self.points @ v, 1) * 1e6) / 1e6
        return [(q, cosine[q]) for q in sorted(range(len(cosine)), key=lambda q: (-cosine[q], q))[:k]]

    def vote(self, near):
        weights = [(1 / (1.05 - c), y) for c, y in near if c > 0]
        return sum(w * y for w, y in weights) / sum(w for w, _ in weights) if weights else self.share

    def score(self, text):
        counts = Counter()
        for w, n in self.words(text).items():
            start = self.at.get("^" + w[:5]) if len(w) > 5 else None
            if start is not None:
                counts[start] += n
            if w in self.at or start is None:
                counts[self.at.get(w, len(self.vocabulary))] += n
        if not counts:
            return self.zero
        vote = self.vote([(c, self.of(*self.counts[q])) for q, c in self.near(self.unit(counts), self.k)])
        return float(np.interp(vote, *zip(*self.steps, strict=True)))
