"""The Jaccard join where blocks are cut up: tiny tiles and chunks, sets of very different sizes, ids with several texts."""

import random

import numpy as np
import pytest
from test_operators import classes, prose


def edited(w, r, share):
    w = list(w)
    for _ in range(max(1, int(len(w) * share))):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return w


@pytest.mark.parametrize(("tile", "chunk"), [(4, 300), (2000, 400_000)])
def test_groups_of_many_sizes(spark, monkeypatch, tile, chunk):
    from millrace.llm import jaccard

    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    r = random.Random(11)
    rows = []
    for size in (3, 12, 130, 260, 900):
        base = prose(size, r).split()
        rows += [(len(rows) + k, " ".join(edited(base, r, x))) for k, x in enumerate([0.0, 0.01, 0.02, 0.03, 0.05, 0.09] * 3)]
    line = prose(30, r)
    rows += [(len(rows) + k, line + " " + prose(k, r)) for k in range(12)]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    rows += [(rows[0][0], rows[40][1]), (rows[3][0], prose(20, r))]  # ids with several texts
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, percent in ((3, 90), (5, 80)):
        assert sorted((tuple(x) for x in jaccard.jaccard_join(df, n=n, percent=percent).collect()), key=str) == classes(rows, n, percent)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_bitmaps_leave_no_partner_out(percent):
    from millrace.llm import sigtree

    g = np.random.default_rng(3)
    sets = []
    for size in [2, 5, 100, 127, 128, 129, 200, 256, 300, 513] * 3:
        base = g.integers(0, 2**63, size).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate([base[size // 8 :], g.integers(0, 2**63, size // 20).astype(np.uint64)]))]
    true = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
    found = {tuple(sorted(x, reverse=True)) for x in sigtree.links(sets, percent, spanning=False)}
    assert found == true
    maps = [sigtree.bitmap(s, sigtree.width_of(len(s))) for s in sets]
    kept = sigtree.partners(maps, np.array([len(s) for s in sets]), percent)
    assert kept[sorted({i for x in true for i in x})].all()
    label = np.arange(len(sets)) // 2
    kept = sigtree.partners(maps, np.array([len(s) for s in sets]), percent, label=label)
    assert not kept.all() and kept[sorted({i for x in true if label[x[0]] != label[x[1]] for i in x})].all()


def test_tables_narrow_and_split_exactly(spark):
    from millrace.llm.shared import by_key, narrowed, without, written

    rows = spark.createDataFrame([(i % 50 if i % 7 else None, i) for i in range(6000)] + [(3, -i) for i in range(3000)], "k long, v long")
    few = spark.createDataFrame([(3,), (4,), (77,)], "k long")
    want = sorted(r.v for r in rows.where("k IN (3, 4)").collect())
    assert set(want) <= {r.v for r in narrowed(rows, few, "k").collect()}
    assert sorted(r.v for r in narrowed(rows, few, "k").join(few, "k").collect()) == want
    assert without(rows, few, "k").count() == 9000 - len(want)
    assert without(rows, few.limit(0), "k").count() == 9000 and narrowed(rows, few.limit(0), "k").count() == 0
    stats = written(rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 5"), "stats")
    assert by_key(rows, stats, ["k"]).count() == rows.where("k <> 5").count()
    left = by_key(rows, stats, ["k"], how="left")
    assert left.count() == 9000 and left.where("n IS NULL").count() == rows.where("k = 5 OR k IS NULL").count()
