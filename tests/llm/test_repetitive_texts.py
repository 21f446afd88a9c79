"""Passages of one character or a short period, rows without id, and very long texts, against brute force over all windows."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import repeats as R


def slow(rows):
    """rows: (order, text) in order, each text of its own; (n_removed, n_spans, sha of what is left) of each."""
    seen, out = set(), []
    for text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int32)
        for i in range(len(raw) - 99):
            w = hashlib.blake2b(raw[i : i + 100], digest_size=12).digest()
            if w in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(w)
        hit = np.cumsum(gone[:-1]) > 0
        spans = int((hit[1:] & ~hit[:-1]).sum() + (hit[:1].sum()))
        out.append((int(hit.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


def texts(rng):
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 4)))
    out = ["x" * n for n in (99, 100, 101, 105, 180, 900)]
    out += ["a b " * 100, "b a " * 60 + "end", "\n" * 400, "ab" * 130 + "x" * 150 + "ab" * 90, "y" + "x" * 300, "x" * 300 + "y", "xy" * 200, "abc" * 150, "é" * 200]
    out += [("line of forty or so characters, " + "no more\n") * k for k in (2, 5, 30)]
    out += [" ".join(word() for _ in range(rng.randint(20, 120))) for _ in range(25)]
    out += ["".join(rng.choice([" " * 130, "z" * 40, "0" * 210, word() * 30, "-=" * 60, out[rng.randrange(len(out))]]) for _ in range(4)) for _ in range(30)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("hot", "share", "piece", "block"), [(R.HOT, R.SHARE, R.PIECE, R.BLOCK), (3, 1, 50, 300), (2, 2, 7, 4000)])
def test_repetitive_texts_equal_brute_force(spark, monkeypatch, hot, share, piece, block):
    for name, v in (("HOT", hot), ("SHARE", share), ("PIECE", piece), ("BLOCK", block)):
        monkeypatch.setattr(R, name, v)
    rows = texts(random.Random(piece))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in R.repeats(docs).collect()}
    assert [got[i] for i in range(len(rows))] == slow(rows)


def test_texts_without_id_come_before_all_others(spark):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdef ", k=150))
    none = [passage + "one", "two" + passage, passage + "one", None, "short"]
    rows = [("in " + passage, 5), ("a" * 50 + passage, -(2**62)), ("".join(rng.choices("gh ", k=300)), 7)]
    docs = spark.createDataFrame([(None, t) for t in none] + [(i, t) for t, i in rows], "doc_id long, text string").repartition(3)
    order = [r.text for r in docs.where("doc_id IS NULL AND text IS NOT NULL").select("text").distinct().orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 40))).collect()]
    order += [t for t, _ in sorted(rows, key=lambda r: r[1])]
    want = dict(zip(order, slow(order), strict=True))
    want[None] = (0, 0, hashlib.sha256(b"").hexdigest())
    texts_of = sorted([(str(i), *want[t]) for i, t in [(None, t) for t in none] + [(i, t) for t, i in rows]])
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in R.repeats(docs).collect()) == texts_of
    assert want["in " + passage][0] == 150
    lost = {r.doc_id: r for r in R.changes(docs).collect()}
    assert set(lost) == {5, -(2**62)}


def test_very_long_repetitive_texts_end(spark):
    rows = ["x" * 2_000_000, "a b " * 300_000, "\n" * 500_000, "x" * 1_000_000 + "y", "the same line again and again, it is sixty characters long.\n" * 20_000, "xy" * 400_000, " ".join(map(str, range(200_000)))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r.doc_id: r for r in R.repeats(docs).collect()}
    assert time.time() - began < 150
    # A text of one period keeps its first; what is x throughout stands in the first text already.
    period = rows[4].index("\n") + 1
    assert [got[i].n_removed for i in range(7)] == [1_999_999, 1_200_000 - 4, 499_999, 1_000_000, len(rows[4]) - period, 800_000 - 2, 0]
    assert [got[i].n_spans for i in range(7)] == [1, 1, 1, 1, 1, 1, 0]
