import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.llm import katz

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def turing(counts, top=100):
    """Good-Turing discounts by count, by their definition over a list of counts: Turing's up to five, else those of a line fitted to
    averaged logarithms."""
    types = Counter(counts)
    seen = sorted(r for r in types if r <= top)
    slope = -2.0
    if len(seen) > 1:
        points = []
        for i, r in enumerate(seen):
            below = seen[i - 1] if i else 0
            above = seen[i + 1] if i + 1 < len(seen) else 2 * r - below
            points.append((math.log(r), math.log(types[r] / (0.5 * (above - below)))))
        mx, my = (sum(p[j] for p in points) / len(points) for j in (0, 1))
        slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
        slope = min(max(slope, -4.0), -1.1)

    def d(r):
        if r <= 5 and types[r] and types[r + 1] and (r + 1) * types[r + 1] < r * types[r]:
            return (r + 1) * types[r + 1] / (r * types[r])
        return (1 + 1 / r) ** (slope + 1)

    return d


class Brute:
    """The model over dictionaries, of any order, with nothing of the module but the size of its table of discounts."""

    def __init__(self, rows, order=2):
        self.order = order
        self.docs = {i: (re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None], zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows}
        self.grams = [Counter() for _ in range(order + 1)]
        self.context = Counter()
        for words, held in self.docs.values():
            for i in range(0 if held else len(words)):
                for m in range(1, order + 1):
                    self.grams[m][self.history(words, i, m) + (words[i],)] += 1
                    self.context[self.history(words, i, m)] += m > 1
        self.one = {w[0]: c for w, c in self.grams[1].items()}
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d = [None, *[turing(g.values()) for g in self.grams[1:]]]
        self.unknown = sum((1 - self.d[1](c)) * c for c in self.one.values() if c <= katz.LEVELS) / self.n
        follow = defaultdict(list)
        for m in range(2, order + 1):
            for g in self.grams[m]:
                follow[g[:-1]].append(g[-1])
        self.alpha = {h: (1 - sum(self.p(h, w) for w in ws)) / (1 - sum(self.p(h[1:], w) for w in ws)) for h, ws in sorted(follow.items(), key=lambda x: len(x[0]))}

    @staticmethod
    def history(words, i, m):
        return tuple([0] * m + words[:i])[len(words[:i]) + 1 :] if m > 1 else ()

    def p(self, h, w):
        c = self.grams[len(h) + 1][h + (w,)]
        if not h:
            return (self.d[1](c) if c <= katz.LEVELS else 1.0) * c / self.n if c else self.unknown
        if c:
            return self.d[len(h) + 1](c) * c / self.context[h]
        return self.alpha.get(h, 1.0) * self.p(h[1:], w)

    def score(self, i):
        words, _ = self.docs[i]
        return sum(math.log10(self.p(self.history(words, j, self.order), w)) for j, w in enumerate(words))


def _rows():
    rng = np.random.default_rng(5)
    words = np.array(["The", "of", "a", "sleep", "walk", "garden", "Light", "day", "x1", "y2", *[f"rare{i}" for i in range(40)]])
    p = np.array([30, 20, 15, 9, 8, 7, 5, 3, 2, 1, *[0.3] * 40])
    return [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(120)] + [(120, ""), (121, None), (122, "  \n"), (123, "unseen words only")]


@pytest.mark.parametrize(("order", "part"), [(2, 100), (2, 5), (3, 100)])
def test_scores_are_those_of_brute_force(docs, monkeypatch, order, part):
    monkeypatch.setattr(katz, "BATCH", 300)
    monkeypatch.setattr(katz, "PART", part)
    rows = _rows()
    brute = Brute(rows, order)
    got = katz.score(docs(rows).repartition(3), katz.is_remainder(F.col("doc_id"), 7, 2), order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        words, held = brute.docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(words), sum(w in brute.one for w in words), brute.n)
        assert math.isclose(r.score, brute.score(r.doc_id), abs_tol=2e-6)
        assert math.isclose(r.base_score, sum(math.log10((brute.one.get(w, 0) + 1) / (brute.n + brute.v + 1)) for w in words), abs_tol=2e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    brute = Brute(_rows(), order)
    for h in [(), *list(brute.alpha)[:40], ("no", "such")[: order - 1]]:
        assert math.isclose(sum(brute.p(h, w) for w in brute.one) + brute.p(h, "never seen"), 1)


def test_keys_are_cut_at_parts():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    for parts in (1, 7, 100_000):
        order, have, cuts = katz._by_part(keys, parts)
        assert cuts[0] == 0 and cuts[-1] == len(keys) and sorted(order) == list(range(len(keys)))
        for p, x, y in zip(have, cuts[:-1], cuts[1:], strict=True):
            mine = keys[order[x:y]]
            assert len(mine) and (np.diff(mine.astype(np.int64)) > 0).all() and set(katz.mix(mine) % np.uint64(parts)) == {np.uint64(p)}


def test_edges(docs):
    held = katz.is_remainder(F.col("doc_id"), 7, 2)
    assert katz.score(docs([(1, "a")]).limit(0), held).count() == 0
    got = katz.score(docs([(4, "a b"), (4, "a b"), (None, "c")]), held).collect()
    assert len(got) == 3 and all(r.score <= 0 for r in got)
    texts = docs([(4, "a b"), (5, "a c")]).selectExpr("'k' || doc_id AS id", "text AS body", "1 AS score")
    assert sorted(r.id for r in katz.score(texts, F.lit(False), "id", "body").collect()) == ["k4", "k5"]
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.score(docs([(only, "a b")]), held).first()  # nothing to learn from
    assert r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0
