"""Ranked search against plain Python, with more items than go together, ties over classes, copies, and hashes that clash."""

import math
import random
import re

import numpy as np
import pytest

from millrace.llm import lexical
from millrace.llm.lexical import Items, Vocabulary, search
from millrace.llm.textkit import TERM, slices, words

DOCS = "doc_id long, text string, item_id long, score long, rank int, m long, n long, terms string, key long"
ITEMS = "item_id long, text string, doc_id long, item string"


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda x: x[0].lower(), t or ""))


def slow(docs, items, top=10):
    bags = [(i if i is not None else -(2**63), terms(t)) for i, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in of.items():
        scored = []
        for doc, b in bags:
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b.count(t) // (1000 * b.count(t) + 8 * (10 + 90 * len(b) * n // length))) for t in asked if t in b)
            if s > 0:
                scored.append((-s, doc))
        out += [(item, k, d if d != -(2**63) else None, -s) for k, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(rng):
    vocabulary = ["".join(rng.choices("abcdeÉé7", k=rng.randint(1, 12))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 25))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(1000 - i, texts[3]) for i in range(40)] + [(2000 + i, " ".join(reversed(texts[3].split()))) for i in range(15)]
    docs += [(70, None), (71, ""), (72, " ,.-\x00 "), (73, "ABC," + texts[5].upper()), (74, " ".join(vocabulary) * 300), (75, "x" * 50_000), docs[2], docs[2], (None, texts[8]), (None, texts[8])]
    items = [(i, " ".join(rng.choices([*vocabulary, "unseen", "UNSEEN2"], k=rng.randint(1, 12)))) for i in range(25)]
    return docs, [*items, (90, None), (91, "...!"), (3, "and-more abc"), (None, vocabulary[0]), items[4]]


@pytest.mark.parametrize("at_once", [2_000, 7])
def test_search_equals_plain_python(spark, monkeypatch, at_once):
    monkeypatch.setattr(lexical, "ITEMS", at_once)
    docs, items = corpus(random.Random(at_once))
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "x", 6) for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS).repartition(2)
    got = search(d, q)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert in_order(got.collect()) == in_order(slow(docs, items))
    assert in_order(search(d, q, top=3).collect()) == in_order(slow(docs, items, 3))


def test_empty_tables(spark):
    docs, items = corpus(random.Random(1))
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "x", 6) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    assert search(d.limit(0), q).collect() == []
    assert search(d, q.limit(0)).collect() == []
    assert search(d.where("coalesce(text, '') = ''"), q).collect() == []


def test_words_of_one_hash_are_told_apart():
    known = Vocabulary([b"abc", b"abd", b"x"])
    data = np.frombuffer(b"abd abc abx ABC x", np.uint8)
    hashes, _, begin = words(data, np.array([0, len(data)]), of=TERM)
    where, term = known.find(data, hashes, begin, np.array([3, 3, 3, 3, 1]))
    assert where.tolist() == [0, 1, 3, 4] and term.tolist() == [1, 0, 0, 2]
    lied = np.full_like(hashes, known.hashes[known.names.tolist().index(0)])  # every word as if it had the hash of abc
    assert known.find(data, lied, begin, np.array([3, 3, 3, 3, 1]))[0].tolist() == [1, 3]


def test_scores_are_whole_numbers_beyond_those_of_doubles():
    known = Items([np.array([0, 1]), np.array([1])], np.array([2**40 + 1, 3]))
    got = known.scores(np.array([10]), np.array([0, 2]), np.array([0, 1], np.int32), np.array([1, 2], np.int32))
    a, b = (2**40 + 1) * (10**9 // 1080), 3 * (2 * 10**9 // 2080)
    assert got.tolist() == [[a + b, b]]


def test_a_word_ends_at_its_row():
    _, _, data, offs = next(slices(__import__("pyarrow").array(["ab", "cd", "", "e f"])))
    hashes, at, begin = words(data, offs, of=TERM)
    row = np.repeat(np.arange(4), np.diff(at))
    assert lexical._word_sizes(data, begin, offs, row).tolist() == [2, 2, 1, 1]
