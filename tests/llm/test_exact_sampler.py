"""The language model's averaged probabilities against a slow sampler that moves one customer at a time."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

D, A = 0.75, 1.0


class Restaurant:
    """Tables of customers by dish; a new table sends a customer to `parent`, or is drawn from `base`."""

    def __init__(self, parent=None, base=0.0):
        self.tables, self.parent, self.base = defaultdict(list), parent, base

    def totals(self):
        return sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))

    def p(self, dish):
        n, t = self.totals()
        up = self.parent.p(dish) if self.parent else self.base
        mine = self.tables.get(dish, [])
        return (sum(mine) - D * len(mine) + (A + D * t) * up) / (A + n) if n else up

    def add(self, dish, r):
        _, t = self.totals()
        up = self.parent.p(dish) if self.parent else self.base
        mine = self.tables[dish]
        x = r.random() * (sum(mine) - D * len(mine) + (A + D * t) * up)
        for i, size in enumerate(mine):
            x -= size - D
            if x < 0:
                mine[i] += 1
                return
        mine.append(1)
        if self.parent:
            self.parent.add(dish, r)

    def remove(self, dish, r):
        mine = self.tables[dish]
        i = r.choices(range(len(mine)), weights=mine)[0]
        mine[i] -= 1
        if not mine[i]:
            del mine[i]
            if self.parent:
                self.parent.remove(dish, r)


def slow(counts, sweeps, burn, r):
    m = len(counts)
    parent = Restaurant(base=1 / m)
    rooms = [Restaurant(parent) for _ in range(m)]
    customers = [(i, j) for i in range(m) for j in range(m) for _ in range(int(counts[i, j]))]
    for i, j in customers:
        rooms[i].add(j, r)
    total = np.zeros((m, m))
    for sweep in range(sweeps):
        for i, j in customers:
            rooms[i].remove(j, r)
            rooms[i].add(j, r)
        if sweep >= burn:
            total += [[rooms[i].p(j) for j in range(m)] for i in range(m)]
    return total / (sweeps - burn)


def test_context_probabilities_are_near_those_of_the_exact_chain():
    from millrace.llm.pitmanyor import context_matrix

    for seed in (2, 3):
        g = np.random.default_rng(seed)
        counts = g.poisson(np.outer(g.gamma(0.7, 2, 8), g.gamma(0.7, 1.5, 8))).astype(float)
        want = slow(counts, 100, 20, random.Random(seed))
        got = context_matrix(counts, burn=10, keep=60)
        assert np.allclose(want.sum(axis=1), 1)
        assert np.abs(got - want).max() < 0.05  # two runs of the slow chain differ by 0.03
        seen = counts > 0
        assert np.abs(np.log10(got[seen] / want[seen])).mean() < 0.04


def test_tables_of_one_dish_have_the_distribution_of_the_chain():
    """Five customers of one dish beside others: the slow chain's shares of 1 to 5 tables against the formula's."""
    from millrace.llm.pitmanyor import log_weights, shares

    r, room = random.Random(3), Restaurant(base=0.2)
    for _ in range(5):
        room.add("x", r)
    seen = Counter()
    for _ in range(20_000):
        room.remove("x", r)
        room.add("x", r)
        seen[len(room.tables["x"])] += 1
    want = shares(log_weights(5, np.array([0.0]), np.array([0.2]), D, A))[0]
    assert np.abs(np.array([seen[t] for t in range(1, 6)]) / 20_000 - want).max() < 0.02


def test_scores_follow_from_the_two_models(spark):
    """Every document's score, worked out in plain Python from the classes' and the rare words' probabilities."""
    from millrace.llm import pitmanyor as P

    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdef", k=3)) for _ in range(60)]
    rows = [(i, " ".join(r.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=r.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, "never seen words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = 9
    tokens = {i: [*(t or "").split(), "\0"] for i, t in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for i in train for x in tokens[i])
    key = lambda x: 1 if x == "\0" else int(np.array(next(P.per_slice(P.pa.array([x])))[2]).view(np.int64)[0])
    top = [x for x, _ in sorted(count.items(), key=lambda kv: (-kv[1], key(kv[0])))[: classes - 1]]
    of = lambda x: top.index(x) if x in top else classes - 1
    cells = np.zeros((classes, classes))
    for i in train:
        for a, b in zip(["\0", *tokens[i]], tokens[i]):
            cells[of(a), of(b)] += 1
    matrix = P.context_matrix(cells)
    rare = Counter(n for x, n in count.items() if x not in top)
    c, q = P.rare_probabilities(spark.createDataFrame(sorted(rare.items()), "c long, words long"))
    p_rare = dict(zip(c.tolist(), q))
    want = {}
    for i, t in tokens.items():
        s = 0.0
        for a, b in zip(["\0", *t], t):
            s += math.log10(matrix[of(a), of(b)])
            if of(b) == classes - 1:
                s += math.log10(p_rare.get(count[b], q[-1]))
        want[i] = round(s, 6)
    got = {x.doc_id: round(x.score, 6) for x in P.score(docs, classes=classes).collect()}
    assert got == want
