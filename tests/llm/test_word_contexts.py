"""The language model's restaurants for every previous word: rare words as contexts, against a slow chain, over many buckets."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from test_exact_sampler import Restaurant

HELD = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 7 == 2]
LEARNED = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 7 != 2]


def test_a_rare_word_is_a_context_of_its_own(spark):
    """1,200 words are each followed by a partner of their own: far likelier than another's partner, however rare the words."""
    from millrace.llm.pitmanyor import score

    r, n = random.Random(1), 1200
    texts = [" ".join(f"a{i} b{i}" for i in r.sample(range(n), 60)) for _ in range(120)]
    asked = [f"a{i} b{j}" for i in range(0, n, 40) for j in (i, (i + 7) % n)]
    rows = [*zip(LEARNED, texts), *zip(HELD, asked)]
    got = {x.doc_id: x.score for x in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for own, other in zip(HELD[: len(asked) : 2], HELD[1 : len(asked) : 2]):
        assert got[own] > got[other] + 1.5


def test_scores_are_near_those_of_the_exact_chain(spark, monkeypatch):
    """Many buckets, most words as hashes, the most frequent contexts dealt to many buckets: the same model."""
    from millrace.llm import contexts
    from millrace.llm.pitmanyor import score

    monkeypatch.setattr(contexts, "FREQUENT", 12)
    monkeypatch.setattr(contexts, "SPREAD", 3)
    monkeypatch.setattr(contexts, "BUCKET", 100)
    r = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    follow = {w: r.sample(vocabulary, 4) for w in ["", *vocabulary]}

    def text():
        out = [""]
        for _ in range(r.randrange(0, 30)):
            out.append(r.choice(follow[out[-1]]) if r.random() < 0.7 else r.choices(vocabulary, weights=[1 / (k + 1) for k in range(40)])[0])
        return " ".join(out[1:])

    rows = [*((i, text()) for i in range(100)), (500, None), (501, "w1 never seen w1 w2 seen w3"), (None, "w1 w2 no id"), (502, "w0 " * 400), (502, "w0 w1")]
    tokens = [(i, [*(t or "").split(), "\0"]) for i, t in rows]
    train = [t for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(x for t in train for x in t)
    parent = Restaurant(base=1 / (len(count) + 1))
    rooms = {w: Restaurant(parent) for w in count}
    customers = [(a, b) for t in train for a, b in zip(["\0", *t], t)]
    for a, b in customers:
        rooms[a].add(b, r)
    pairs = {(a, b) for _, t in tokens for a, b in zip(["\0", *t], t)}
    total, sweeps, burn = Counter(), 40, 10
    for sweep in range(sweeps):
        for a, b in customers:
            rooms[a].remove(b, r)
            rooms[a].add(b, r)
        if sweep >= burn:
            for a, b in pairs:
                total[a, b] += rooms.get(a, parent).p(b) / (sweeps - burn)
    want = sorted((str(i), len(t), sum(count[x] > 0 for x in t), round(sum(math.log10((count[x] + 1) / (sum(count.values()) + len(count) + 1)) for x in t), 6)) for i, t in tokens)
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    chain = {(str(i), len(t)): sum(math.log10(total[a, b]) for a, b in zip(["\0", *t], t)) for i, t in tokens}
    off = np.array([(x.score - chain[str(x.doc_id), x.n_tokens]) / x.n_tokens for x in got])
    assert np.abs(off).max() < 0.12 and np.abs(off).mean() < 0.02


def test_the_most_frequent_words_are_few_whatever_the_counts(spark, monkeypatch):
    from millrace.llm import contexts

    monkeypatch.setattr(contexts, "FREQUENT", 10)
    take = lambda c: [x.c for x in contexts._frequent(spark.createDataFrame(list(enumerate(c)), "h long, c long"))]
    assert take([5, 900, 3, 70]) == [900, 70, 5, 3]
    assert take([900, 70, *[4] * 20]) == [900, 70]
    assert take([4] * 20) == []


def test_one_common_successor_and_no_training_rows(spark):
    from millrace.llm.pitmanyor import score

    rows = [(HELD[0], "a b"), (HELD[1], None), (None, "x")]
    got = score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.score, 9), round(x.base_score, 9)) for x in got} == {
        (HELD[0], True, 3, 0, 0, 0, 0),
        (HELD[1], True, 1, 0, 0, 0, 0),
        (None, False, 2, 0, 0, 0, 0),
    }
