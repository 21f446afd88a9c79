"""The factorization machine's sums against all pairs, and every document's score against the model's own numbers."""

import math
import zlib

import numpy as np
from test_operators import prose


def slow(m, terms):
    total = m.bias + sum(float(m.w[i]) for i in terms)
    for a in range(len(terms)):
        for b in range(a):
            total += float(np.dot(m.v[terms[a]].astype(float), m.v[terms[b]].astype(float)))
    return total


def test_pair_sums():
    from millrace.llm.toxicity import FACTORS, FEATURES, Machine

    g = np.random.default_rng(3)
    m = Machine()
    m.w, m.v = g.normal(0, 1, FEATURES).astype(np.float32), g.normal(0, 0.3, (FEATURES, FACTORS)).astype(np.float32)
    rows = [np.sort(g.choice(FEATURES, n, replace=False)) for n in (0, 1, 2, 30, 0)]
    assert np.allclose(m.score(rows), [slow(m, r) for r in rows], atol=1e-4)


def test_every_score_follows_from_the_model(spark):
    import random

    import pyarrow as pa
    from millrace.llm.toxicity import Machine, terms, toxicity, train

    r = random.Random(8)
    rows = []
    for i in range(240):
        bad, group = i % 3 == 0, i % 2 == 0
        rows.append((i, prose(12, r) + (" vile" if bad else "") + (" them" if group else "") + " " + prose(6, r)))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "vile them")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    m = Machine.from_bytes(train(docs, labels.where(labels.doc_id.isin([i for i in range(240) if not held(i)]))))
    want = {}
    for i, t in [*rows, (500, None), (501, ""), (None, "vile them")]:
        x = next(terms(pa.array([t], pa.string()), m.active))
        want[i] = 1 / (1 + math.exp(-slow(m, x)))
    got = {x.doc_id: x for x in toxicity(docs, labels).collect()}
    assert set(got) == set(want)
    for i, x in got.items():
        assert math.isclose(x.score, want[i], abs_tol=1e-4) and x.predicted == int(x.score >= 0.5) and x.held_out == held(i)
    # The insult with the group is toxic and either alone is not: rows never trained on are told apart.
    unseen = [i for i in range(240) if held(i)]
    assert sum(got[i].predicted == (i % 6 == 0) for i in unseen) >= 0.9 * len(unseen)
