"""Phrases against plain Python, with few numbered words, small shards and many ranges; filters against counters."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import collocations as C
from millrace.llm import quotient as Q

SCHEMA = "doc_id long, text string, lang string, n long, h long, f long, rank int, score long, phrase string, word string"


@pytest.mark.parametrize("bits", [1, 2, 3, 8, 13, 21, 42, 63, 64])
def test_the_map_is_one_to_one(bits):
    rng = random.Random(bits)
    keys = np.array(range(1 << bits) if bits <= 13 else [0, (1 << bits) - 1, *(rng.randrange(1 << bits) for _ in range(2000))], np.uint64)
    there = Q.permuted(keys, bits)
    assert there.max() <= (1 << bits) - 1
    assert (Q.restored(there, bits) == keys).all()
    if bits <= 13:
        assert len(set(there.tolist())) == 1 << bits


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3), st.one_of(st.integers(1, 3), st.integers(1, 2**62))), max_size=120), st.booleans())
def test_filters_keep_every_key_and_count(bits, rows, wide):
    want = Counter()
    for k, x, c in rows:
        want[(k % (1 << bits), *([x] if wide else []))] += c % (2**62 // 120) + 1
    keys = sorted(want)
    cols = tuple(np.array([k[i] for k in keys], np.uint64) for i in range(2 if wide else 1))
    raw = Q.encode(cols, np.array([want[k] for k in keys], np.uint64), bits)
    got, counts = Q.Filter(raw).entries()
    assert list(zip(*(g.tolist() for g in got), strict=True)) == keys
    assert counts.tolist() == [want[k] for k in keys]
    twice, sums = Q.merged([raw, Q.encode(tuple(c[:0] for c in cols), np.zeros(0, np.uint64), bits), raw])
    assert list(zip(*(g.tolist() for g in twice), strict=True)) == keys and sums.tolist() == [2 * want[k] for k in keys]
    if not wide:
        assert [Q.Filter(raw).count(k[0]) for k in keys] == [want[k] for k in keys]
        for other in (0, (1 << bits) - 1, 5 % (1 << bits)):
            assert Q.Filter(raw).count(other) == want[(other,)]


def test_filters_are_smaller_than_their_keys():
    rng = np.random.default_rng(1)
    keys, counts = Q.added((np.sort(Q.permuted(rng.integers(0, 1 << 40, 200_000).astype(np.uint64), 40)),))
    assert len(Q.encode(keys, counts, 40)) / len(counts) < 4  # 8 bytes a key, and a count


def slow(rows, least, best=2000, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda x: x[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        mine = []
        for p, a in f.items():
            if p[0] != lang or len(p) == 2 or a < least:
                continue
            if len(p) == 3 and any(b >= least and 100 * b >= covered * a and len(q) == 4 and q[0] == lang and (q[1:3] == p[1:] or q[2:] == p[1:]) for q, b in f.items()):
                continue
            s, k, l, r = min((1_000_000 * a * a // (f[p[: 1 + k]] * f[(lang, *p[1 + k :])]), k, f[p[: 1 + k]], f[(lang, *p[1 + k :])]) for k in range(1, len(p) - 1))  # noqa: E741
            mine.append((-s, -a, " ".join(p[1:]).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:best], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÉé7'-", k=rng.randint(1, 5))) for _ in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    made = lambda: "".join(rng.choices(vocabulary, weights)[0] + rng.choices([" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ?! ", "\x0b", "\x1c", "\x00"], [30, 2, 1, 2, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "de", None, "und", ""]), made()) for _ in range(120)]
    rows += [("en", "New York City is big. " * 12), ("en", "a a a a a a a"), ("fr", None), ("fr", ""), ("es", " .,; "), ("xx", "once only"), ("en", "y" * 30_000 + " zz"), ("it", "due parole " * 20_000)]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize(("numbered", "shard", "size"), [(C.NUMBERED, C.SHARD, C.RANGE), (12, 500, 100), (0, 1, 50)])
def test_phrases_equal_plain_python(spark, monkeypatch, numbered, shard, size):
    monkeypatch.setattr(C, "NUMBERED", numbered)
    monkeypatch.setattr(C, "SHARD", shard)
    monkeypatch.setattr(C, "RANGE", size)
    rows = corpus(numbered % 97)
    docs = spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, 5, "x", "y") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    got = C.collocations(docs, least=3)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert sorted(map(tuple, got.collect())) == slow(rows, 3)
    if numbered > 1000:
        assert sorted(map(tuple, C.collocations(docs, least=2, best=4, covered=80).collect())) == slow(rows, 2, 4, 80)


def test_words_of_one_hash_get_another_hash_function(spark, monkeypatch):
    rows = [("en", "ab cd ab cd ab cd"), ("en", "ef gh ef gh")]
    docs = spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, 5, "x", "y") for i, (lang, t) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(C, "_BYTE", np.zeros(256, np.uint64))  # every word of one length has one hash
    assert sorted(map(tuple, C.collocations(docs, least=2).collect())) == slow(rows, 2)


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 10**14 + 7, 10**15 - 1, 3 * 10**14 + 11  # noqa: E741
    df = spark.range(1).select(F.lit(a).alias("a"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    assert df.select(C.score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (l * r)


def test_an_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
